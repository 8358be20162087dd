"""Sections and overlapping sentence windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T


def sections(files: DataFrame) -> DataFrame:
    """``files(src_ord, name, text)`` → ``(src_ord, sec_ord, source_ref, text)``.

    In Markdown, a line that starts with ``#`` opens a section if there is
    anything before it; other files are one section. Sections are cleaned, empty
    ones dropped, and the rest numbered from 1. Everything happens inside a
    file's row, so no shuffle.
    """
    markdown = F.lower(F.substring_index("name", ".", -1)) == "md"
    lines = F.transform(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), T.clean)
    # blank lines neither open nor fill a section
    filled = F.filter(lines, lambda x: x != "")
    mark = F.transform(filled, lambda x, i: F.when(markdown & (i > 0) & x.startswith("#"), F.concat(F.lit("\n"), x)).otherwise(x))
    blocks = F.filter(F.transform(F.split(F.array_join(mark, " "), "\n"), T.clean), lambda x: x != "")
    each = files.select("src_ord", "name", F.posexplode(blocks).alias("pos", "text"))
    ref = F.concat_ws(":", F.substring_index("name", "/", -1), F.lit("section"), (F.col("pos") + 1).cast("string"))
    return each.select("src_ord", (F.col("pos") + 1).alias("sec_ord"), ref.alias("source_ref"), "text")


def windows(sections: DataFrame, keys: list[str], target: int = 512, overlap: int = 64) -> DataFrame:
    """``sections(*keys, text)`` → ``(*keys, win_ord, first, last, text)``: sentence windows ``[first, last)``.

    A window takes sentences while their joined length stays within the target
    (at least one), and the next begins as many sentences back as fit the overlap
    (at least one, but always further than the last). Both bounds are range
    frames over cumulative lengths; the walk from window to window is a fold
    over one section's array. A section is bounded by its text, whatever the
    corpus's size.
    """
    reach = max(target, 128)
    back = min(max(overlap, 0), reach // 2)
    # an empty sentence at the end marks where the text ends
    units = sections.withColumn("units", F.array_append(T.sentences(F.col("text")), F.lit("")))
    # an inner explosion would make Spark infer a filter, which would split the sentences twice
    each = units.select(*keys, F.posexplode_outer("units").alias("i", "s")).where("i is not null").withColumn("len", F.length("s") + 1)
    order = Window.partitionBy(*keys).orderBy("i")
    rows = each.withColumn("p", F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("len")).select(*keys, "i", "p", "s")
    along = Window.partitionBy(*keys).orderBy("p")
    n = F.count("*")
    framed = rows.withColumn("fit", n.over(along.rangeBetween(1, reach + 1))).withColumn("rewind", n.over(along.rangeBetween(-(back + 1), -1)))
    whole = framed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "fit", "rewind", "s"))).alias("b"))
    n_units = F.size("b") - 1
    step = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<first:int,last:int>>").alias("out"))

    def walk(acc, b):
        end = b["i"] + F.greatest(F.lit(1), b["fit"].cast("int"))
        stop = end >= n_units
        after = F.when(stop, n_units).otherwise(F.greatest(b["i"] + 1, end - F.greatest(F.get("b", end)["rewind"].cast("int"), F.lit(1))))
        here = (b["i"] == acc["next"]) & (b["i"] < n_units)
        window = F.struct(b["i"].alias("first"), F.least(end, n_units).alias("last"))
        return F.struct(F.when(here, after).otherwise(acc["next"]).alias("next"), F.when(here, F.array_append(acc["out"], window)).otherwise(acc["out"]).alias("out"))

    found = whole.select(*keys, "b", F.posexplode(F.aggregate("b", step, walk, lambda a: a["out"])).alias("win_ord", "w"))
    text = F.array_join(F.transform(F.slice("b", F.col("w.first") + 1, F.col("w.last") - F.col("w.first")), lambda x: x["s"]), " ")
    return found.select(*keys, "win_ord", F.col("w.first").alias("first"), F.col("w.last").alias("last"), text.alias("text"))


def number(windows: DataFrame, keys: list[str], span: int = 65_536) -> DataFrame:
    """Windows with a global ``chunk_ord`` from 0 and ``chunk_id``, in the order of ``keys`` (whole numbers) and ``win_ord``.

    Prefix sums in two levels: over blocks of ``span`` values of the first key,
    a row each, and over the sections of a block. Chunks themselves are only joined.
    """
    per = windows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("blk", F.floor(F.col(keys[0]) / span))
    blocks = per.groupBy("blk").agg(F.sum("n").alias("m"))
    blocks = blocks.withColumn("base", F.sum("m").over(Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m"))
    inner = F.sum("n").over(Window.partitionBy("blk").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    before = per.withColumn("upto", inner).join(blocks.select("blk", "base"), "blk").select(*keys, (F.col("base") + F.col("upto")).alias("base"))
    ord_ = (F.col("base") + F.col("win_ord")).cast("long")
    return windows.join(before, keys).withColumn("chunk_ord", ord_).withColumn("chunk_id", T.chunk_id(ord_)).drop("base")
