"""Readers and writers: JSON arrays (S4-S6), CSV with BOM (K2-K4), JSON documents (K1, K7), batches (K6).

A JSON array file is read as one value and exploded with its positions, so order
and unknown keys survive; a byte order mark is always dropped (S4c).  Spark's own
commit protocol makes every write atomic (K5).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V

ARTICLE_FIELDS = tuple("document_name article_number livre titre chapitre section sous_section pages content source_relative_path".split())
CHUNK_FIELDS = tuple("chunk_id chunk_index chunk_count article_number document_name livre titre chapitre section sous_section pages source_relative_path content".split())


def json_items(spark: SparkSession, path: str, strict: bool = True, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """(source_file, pos, item VARIANT) of JSON array files.  Strict: anything but an array of objects is an error (S4); else other items are left out."""
    options = {"recursiveFileLookup": str(recursive).lower()} | ({"pathGlobFilter": pattern} if pattern else {})
    whole = spark.read.options(**options).text(path, wholetext=True)
    parsed = whole.select(F.col("_metadata.file_path").alias("source_file"), F.parse_json(F.regexp_replace("value", "^\\ufeff", "")).alias("v"))
    kind = F.schema_of_variant("v").startswith("ARRAY<")
    parsed = parsed.withColumn("v", F.when(kind, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("not a JSON array: "), F.col("source_file"))).cast("variant")))
    items = parsed.select("source_file", F.posexplode(F.expr("try_variant_get(v, '$', 'array<variant>')")).alias("pos", "item"))
    is_object = F.schema_of_variant("item").startswith("OBJECT<")
    if strict:
        return items.withColumn("item", F.when(is_object, F.col("item")).otherwise(F.raise_error(F.lit("an item is not an object")).cast("variant")))
    return items.where(is_object)


def fields(items: DataFrame, names: tuple[str, ...] = ARTICLE_FIELDS, kind: str = "string") -> DataFrame:
    """Typed columns of the items, next to the item itself so that unknown keys survive."""
    return items.select("*", *(F.try_variant_get("item", f"$.{n}", kind).alias(n) for n in names))


def embedded_corpus(spark: SparkSession, path: str, names: tuple[str, ...] = ARTICLE_FIELDS) -> DataFrame:
    """Articles with vectors in any encoding, from ``*_embedded.json`` below the path, or if there is none from all ``*.json``."""
    chosen = None
    for pattern in ("*_embedded.json", "*.json"):
        found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).format("binaryFile").load(path).select("path")
        if chosen is None and found.head(1):
            chosen = pattern
    if chosen is None:
        raise FileNotFoundError(f"no JSON file below {path}")
    rows = fields(json_items(spark, path, False, chosen, True), names)
    vector = V.from_variant(F.try_variant_get("item", "$.embedding", "variant"))
    return rows.withColumn("embedding", vector).withColumn("embedded_file", F.substring_index("source_file", "/", -1))


FEW = 64


def row_groups(spark: SparkSession, paths: list[str]) -> int:
    """Row groups of some Parquet files, from their footers."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for path in paths:
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf))
        try:
            n += reader.getRowGroups().size()
        finally:
            reader.close()
    return n


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows of a Parquet table over all cores, by keys if given, where its files hold fewer row groups than there are cores: a row group is read by one task.

    Tables of more files than cores (or than ``FEW``, whose footers would take a while
    to read), or of more row groups, are left as they are, without a shuffle.
    """
    spark = df.sparkSession
    cores, paths = spark.sparkContext.defaultParallelism, df.inputFiles()
    if 0 < len(paths) < min(cores, FEW) and row_groups(spark, paths) < cores:
        return df.repartition(cores, *keys)
    return df


BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of some megabytes, unless the session has smaller ones: texts are long, and each task holds a batch on both sides.

    The setting is the session's and stays, as results are computed when they are asked for.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    digits = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
    if digits is None or int(digits[1]) > BATCH_BYTES or int(digits[1]) <= 0:
        spark.conf.set(name, str(BATCH_BYTES))


def file_count(df: DataFrame) -> int:
    """Files with at least one item."""
    return df.select("source_file").distinct().count()


def csv(df: DataFrame, path: str, columns: tuple[str, ...] | None = None, bom: bool = True) -> None:
    """K2, K3: a header and the columns in order; the first header cell carries a byte order mark."""
    rows = df.select(*columns) if columns else df
    if bom and rows.columns:
        rows = rows.withColumnRenamed(rows.columns[0], "﻿" + rows.columns[0])
    rows.write.mode("overwrite").option("header", "true").option("quoteAll", "false").option("escape", '"').csv(path)


def json_lines(df: DataFrame, path: str, by: str | None = None) -> None:
    """K1 as JSON lines; K6: a folder per value of ``by``."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def articles_with_ids(spark: SparkSession, path: str, strict: bool = True, ids: bool = False) -> DataFrame:
    """The items of a folder's ``*_articles.json`` files, or with ``ids`` of its ``*_with_ids.json``, sorted by path and place."""
    return json_items(spark, path, strict, "*_with_ids.json" if ids else "*_articles.json").orderBy("source_file", "pos")


def output_name(stem: str, pages: int = 0) -> str:
    """K1: the name of a document's article file; a page limit is part of it."""
    return f"{stem}{f'_first_{pages}p' if pages > 0 else ''}_articles.json"


def union_csv(parts: Sequence[DataFrame], path: str) -> None:
    """K3: all columns of all parts, in the order they first come; cells that a part lacks are empty."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    csv(whole, path)


def json_document(df: DataFrame, path: str, file: str, order: str) -> None:
    """K1, K7: one array per source file, as one text row each; a file is as large as one document."""
    record = F.struct(*[c for c in df.columns if c not in (file, order)])
    arrays = df.groupBy(file).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), record.alias("r")))), lambda s: s["r"]), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))
    arrays.write.mode("overwrite").partitionBy(file).text(path)
