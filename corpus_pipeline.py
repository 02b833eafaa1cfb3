"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return the
columns of ``documents``; where a text changes, ``n_chars`` follows it.

1. quality rules: documents that the rules or the trees reject go;
2. line dedup: later occurrences of repeated three-line passages are cut; a
   document of which no word is left goes with them;
3. near duplicates: of each group linked by 5-gram Jaccard similarity of 0.8 or
   more, one row stays: of the smallest id, then of the least hash of text, one of
   equal rows; a row without an id only where no row of its group has one.  Rows
   without a word are in no group, but equal ones with an id are one document;
4. personal data is replaced by the name of its kind;
5. best-fit packing of the token pieces into sequences of 2048.

Empty tables pass through all stages; the operators' docstrings say what they do
with nulls, empty texts and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import jaccard, lines, packing, pii, quality
from quillon.llm.components import components
from quillon.llm.queries_text import byte_bpe
from quillon.llm.tables import documents, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, model).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = lines.dedup_lines(docs)
    left = cut.where("n_removed = 0 or text rlike '[^ \\\\t-\\\\r]'")
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = written(jaccard.classed(docs).withColumn("_row", F.monotonically_increasing_id()), "classed")
    links = written(jaccard.join(rows.select("doc_id", "text"))["links"], "linked")
    root = components(links).select(F.col("node").alias("_cls"), "root")
    keyed = rows.select("_row", "doc_id", F.xxhash64("text").alias("h"), "_cls").join(root, "_cls", "left").withColumn("root", F.coalesce("root", "_cls"))
    # what no word is in has no group: its repeated rows are one document, without an id each is its own
    blank = F.col("root").isNull()
    alone = blank & F.col("doc_id").isNull()
    group = ["root", F.when(blank, F.col("doc_id")).alias("i"), F.when(blank, F.col("h")).alias("t")]
    first = keyed.where(~alone).groupBy(*group).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h", "_row")).alias("m")).select("m._row")
    stay = first.union(keyed.where(alone).select("_row"))
    return rows.join(stay.hint("shuffle_hash"), "_row", "left_semi").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, byte_bpe())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: Models, sketches and tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
