"""Text, Markdown and PDF files as sections."""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import chunking

FORMATS = ("md", "pdf", "txt")


def discover(spark: SparkSession, path: str) -> DataFrame:
    """``(src_ord, name, content)`` of a file, or of the files of known formats right in a folder, in order of paths.

    A single file is taken whatever its ending. Nothing found is an error.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select(F.col("path").alias("name"), "content")
    if not found.columns:
        raise FileNotFoundError(path)
    ending = F.lower(F.substring_index("name", ".", -1))
    single = found.select("name").limit(2).collect()
    if len(single) == 1 and single[0][0].rstrip("/").endswith("/" + path.rstrip("/").rpartition("/")[2]):
        chosen = found
    else:
        chosen = found.where(ending.isin(*FORMATS))
    names = sorted(r[0] for r in chosen.select("name").collect())  # one row a file of the folder
    if not names:
        raise FileNotFoundError(f"no {', '.join(FORMATS)} file in {path}")
    order = spark.createDataFrame(list(enumerate(names)), "src_ord int, name string")
    return chosen.join(order, "name").select("src_ord", "name", "content")


def read_text(files: DataFrame) -> DataFrame:
    """Sections of text and Markdown files; bytes that aren't UTF-8 are left out."""

    def decode(batches):
        for batch in batches:
            text = [b.decode("utf-8", "ignore") for b in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["src_ord", "name", "text"])

    return chunking.sections(files.mapInArrow(decode, "src_ord int, name string, text string"))


def read_pdf(files: DataFrame) -> DataFrame:
    """A section for each page with text, by its physical number. Needs ``pypdf``."""

    def pages(batches):
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("PDF files need the package pypdf") from e
        for batch in batches:
            out = [(o, n, k, p.extract_text() or "") for o, n, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, p in enumerate(PdfReader(io.BytesIO(b)).pages, 1)]
            yield pa.RecordBatch.from_pylist([dict(zip(("src_ord", "name", "sec_ord", "text"), r, strict=True)) for r in out], pa.schema([("src_ord", pa.int32()), ("name", pa.string()), ("sec_ord", pa.int32()), ("text", pa.string())]))

    read = files.mapInArrow(pages, "src_ord int, name string, sec_ord int, text string").withColumn("text", T.clean(F.col("text"))).where("text <> ''")
    ref = F.concat_ws(":", F.substring_index("name", "/", -1), F.lit("page"), F.col("sec_ord").cast("string"))
    return read.select("src_ord", "sec_ord", ref.alias("source_ref"), "text")


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """``(src_ord, sec_ord, source_ref, text)`` of all files of a path; other formats are an error."""
    files = discover(spark, path)
    ending = F.lower(F.substring_index("name", ".", -1))
    other = files.where(~ending.isin(*FORMATS)).select("name").first()
    if other:
        raise ValueError(f"{other[0]} is none of: {', '.join(FORMATS)}")
    plain = read_text(files.where(ending != "pdf"))
    if files.where(ending == "pdf").select("name").isEmpty():
        return plain
    return plain.unionByName(read_pdf(files.where(ending == "pdf")))
