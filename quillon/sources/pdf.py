"""PDF pages as a line table (S1).  Needs PyMuPDF on the workers; everything after starts from the line table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc string, page int, line_no int, block_type int, spans array<struct<text:string,size:double,font:string>>, y0 double, y1 double, page_height double"


def read(spark: SparkSession, path: str, pages: int = 0) -> DataFrame:
    """Spans of every line of the PDF files at a path (not below it), sorted by name; the first ``pages`` pages where that is above 0."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")

    def lines(batches):
        import fitz

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows = []
                with fitz.open(stream=content, filetype="pdf") as pdf:
                    for number, page in enumerate(pdf, 1):
                        if 0 < pages < number:
                            break
                        n = 0
                        for block in page.get_text("dict")["blocks"]:
                            for line in block.get("lines", ()):
                                box = line["bbox"]
                                spans = [{"text": s["text"], "size": s["size"], "font": s["font"]} for s in line["spans"]]
                                rows.append((name.rsplit("/", 1)[-1].removesuffix(".pdf"), number, n, block["type"], spans, box[1], box[3], page.rect.height))
                                n += 1
                yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in ("doc", "page", "line_no", "block_type", "spans", "y0", "y1", "page_height")])

    return files.mapInPandas(lines, SCHEMA)
