"""Sources and sinks: tables, line blocks of texts, tags of pages, JSON and CSV exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def line_blocks(docs: DataFrame) -> DataFrame:
    """Non-blank lines of texts as blocks (doc_id, line_no, block_id, text), in reading order."""
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "text"))
    rows = rows.where(F.trim("text") != "").withColumn("line_no", F.col("line_no").cast("long"))
    return rows.select("doc_id", "line_no", F.concat(F.lit("b_p1_"), F.col("line_no")).alias("block_id"), "text")


def page_tags(pages: DataFrame, tag: str) -> DataFrame:
    """Contents of a tag in each page, in order: (page_id, pos, content)."""
    found = F.regexp_extract_all("html", F.lit(rf"<{tag}>([^<]*)</{tag}>"), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("pos", "content")).withColumn("pos", F.col("pos").cast("long"))


def upload_guard(files: DataFrame, *, name: str, head: str, size: str, most: int, extension: str = ".pdf", magic: str = "%PDF-") -> DataFrame:
    """Adds `reason`: why an upload is refused, null if it isn't."""
    reason = F.when(~F.lower(F.col(name)).endswith(extension), F.lit("extension")).when(F.col(size) > most, F.lit("too large")).when(~F.col(head).startswith(magic), F.lit("not a pdf"))
    return files.withColumn("reason", reason)


def pdf_blocks(files: DataFrame) -> DataFrame:
    """Text blocks of PDF files from `binaryFile` rows; needs the optional library fitz."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("pdf_blocks needs the optional library fitz (PyMuPDF)") from e

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with fitz.open(stream=content, filetype="pdf") as doc:
                    for page_no, page in enumerate(doc, 1):
                        for x0, y0, x1, y1, text, *_ in page.get_text("blocks"):
                            rows.append((path, page_no, x0, y0, x1, y1, text.strip()))
            yield pd.DataFrame(rows, columns=["path", "page", "x0", "y0", "x1", "y1", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, x0 double, y0 double, x1 double, y1 double, text string")


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_csv(long_form: DataFrame, path: str) -> None:
    """RFC 4180: header, CRLF line ends, quotes doubled."""
    long_form.write.option("header", True).option("lineSep", "\r\n").option("escape", '"').csv(path)
