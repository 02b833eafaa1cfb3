"""The stages from the command line: ``python -m quillon.stages STAGE IN OUT``; ``service`` has the search.

Each stage reads a folder and writes one, so any of them can be run again, or be
replaced by a job that writes the same table.  Tables between stages are JSON arrays,
one per document, as the readers of ``sources.files`` take them.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import providers
from .operators import articles, chunks, lines, questions, tables
from .remote import provider
from .sources import files
from .streaming import incremental


def _items(spark: SparkSession, path: str, pattern: str | None, names: tuple[str, ...]) -> DataFrame:
    return files.fields(files.json_items(spark, path, True, pattern), names).drop("item")


def extract(spark: SparkSession, a: argparse.Namespace) -> None:
    """Lines (a Parquet table, or PDF files) to ``<document>_articles.json`` arrays."""
    if a.pdf:
        from .sources import pdf

        rows = lines.assemble(pdf.read(spark, a.source, a.pages))
    else:
        rows = lines.first_pages(spark.read.parquet(a.source), a.pages)
    made = articles.extract(rows)
    name = F.concat(F.col("document_name"), F.lit(files.output_name("", a.pages)))
    files.json_document(made.withColumn("file", name), a.out, "file", "pos")


def ids(spark: SparkSession, a: argparse.Namespace) -> None:
    """Articles to articles with ids (W1), and all of them as one CSV with a byte order mark (K3)."""
    rows = _items(spark, a.source, a.pattern, files.ARTICLE_FIELDS)
    name = F.substring_index(F.regexp_replace("source_file", "/part-[^/]*$", ""), "/", -1)  # of the file, or of the folder that a stage wrote
    stem = F.regexp_replace(name, "^file=|(_articles)?[.]json$", "")
    made = tables.assign_ids(rows, "source_file", "pos").withColumn("file", F.concat(stem, F.lit("_with_ids.json")))
    files.json_document(made.drop("source_file"), f"{a.out}/json", "file", "pos")
    files.csv(made.select("id", *files.ARTICLE_FIELDS), f"{a.out}/csv")


def chunk(spark: SparkSession, a: argparse.Namespace) -> None:
    """Articles to chunk records, by meaning where a provider is given, else by length (V8, V9)."""
    rows = _items(spark, a.source, a.pattern, files.ARTICLE_FIELDS)
    p = chunks.Packing(a.target, a.most, a.similarity)
    packed = chunks.pack_by_meaning(rows, providers.embed_arrays(_embedder(a)), "content", p) if a.provider else chunks.pack_by_length(rows, "content", p)
    numbered = tables.clean_chunks(chunks.records(packed.drop("content")).withColumn("_at", F.struct("pos", "chunk_index")), "source_file", "_at")
    numbered.drop("_at").write.mode("overwrite").json(a.out)


def embed(spark: SparkSession, a: argparse.Namespace) -> None:
    """Articles to the store of vectors; those that are there stay."""
    rows = _items(spark, a.source, a.pattern, files.ARTICLE_FIELDS)
    failed = incremental.backfill(spark, rows, a.out, _embedder(a))
    print(json.dumps({"failed": failed, "stored": spark.read.parquet(a.out).count()}))


def ask(spark: SparkSession, a: argparse.Namespace) -> None:
    """Articles to question sets in numbered batches, with a summary."""
    rows = _items(spark, a.source, a.pattern, ("id", *files.ARTICLE_FIELDS)).withColumn("id", F.col("id").cast("long"))
    take = questions.target(rows.count(), a.per_article, a.least, a.total)
    said = questions.run(spark, rows, a.out, _chat(a), a.per_article, a.batch, take)
    answers = spark.read.parquet(f"{a.out}/answers")
    questions.batch_files(answers, f"{a.out}/batches")
    summary = questions.summary(answers.where("questions is not null").select("article_id", "questions"), a.source, a.model or "offline", a.per_article, a.batch, a.least)
    if said["status"] == "stopped":
        summary = summary.withColumn("status", F.lit("stopped")).withColumn("stopped_reason", F.lit(said["stopped_reason"]))
    summary.coalesce(1).write.mode("overwrite").json(f"{a.out}/summary")
    questions.wide(answers.where("questions is not null").select("article_id", "questions"), a.per_article).write.mode("overwrite").option("header", "true").csv(f"{a.out}/wide")
    print(json.dumps(said, ensure_ascii=False))


def _embedder(a: argparse.Namespace) -> providers.Embedder:
    return provider(a.provider, url=a.url, model=a.model, key=a.key) if a.provider else providers.HashingEmbedder()


def _chat(a: argparse.Namespace) -> providers.Chat:
    return provider(a.provider, url=a.url, model=a.model, key=a.key) if a.provider else providers.TemplateChat()


STAGES = {"extract": extract, "ids": ids, "chunk": chunk, "embed": embed, "backfill": embed, "questions": ask}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillon.stages", description="One stage from a folder to a folder.")
    p.add_argument("stage", choices=sorted(STAGES))
    p.add_argument("source")
    p.add_argument("out")
    p.add_argument("--pattern", help="names of the files to read")
    p.add_argument("--pdf", action="store_true", help="extract: the source holds PDF files")
    p.add_argument("--provider", metavar="MODULE:OBJECT", help="e.g. quillon.remote:HttpEmbedder")
    for name in ("url", "model", "key"):
        p.add_argument(f"--{name}", default="")
    for name, kind, usual in (("pages", int, 0), ("target", int, 900), ("most", int, 1400), ("similarity", float, 0.72), ("per-article", int, 10), ("batch", int, 5), ("least", int, 100), ("total", int, 200)):
        p.add_argument(f"--{name}", type=kind, default=usual)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    STAGES[a.stage](SparkSession.builder.appName(f"articles-{a.stage}").getOrCreate(), a)


if __name__ == "__main__":
    main()
