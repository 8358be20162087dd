"""Files that arrive in a folder, chunked as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.operators import chunking


def watch(spark: SparkSession, folder: str, out: str, state: str, chunk_size: int = 512, chunk_overlap: int = 64, once: bool = False) -> StreamingQuery:
    """Append ``(name, sec_ord, win_ord, source_ref, text)`` of each new text or Markdown file to ``out``.

    Each micro-batch is written to a folder named by its number, so a batch that
    runs again after a failure replaces itself. ``state`` keeps what has been read.
    """
    lines = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.{txt,md}").load(folder).select(F.col("_metadata.file_path").alias("name"), F.col("value").alias("text"))

    def write(batch: DataFrame, number: int) -> None:
        files = batch.withColumn("src_ord", F.xxhash64("name"))
        sections = chunking.sections(files)
        keys = ["src_ord", "sec_ord"]
        windows = chunking.windows(sections.select(*keys, "text"), keys, chunk_size, chunk_overlap)
        named = windows.join(sections.select(*keys, "source_ref"), keys).join(files.select("src_ord", "name"), "src_ord")
        named.select("name", "sec_ord", "win_ord", "source_ref", "text").write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = lines.writeStream.foreachBatch(write).option("checkpointLocation", state)
    return (stream.trigger(availableNow=True) if once else stream).start()
