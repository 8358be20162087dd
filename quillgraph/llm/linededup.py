r"""Line deduplication over content-defined chunks of lines, in DataFrame functions alone.

A line's hash is the first eight digits of its MD5. A rolling hash runs over the
last two line hashes, and a chunk ends after a line where it is less than at the
lines before and after: never after two lines in a row, so chunks have two
lines or more, and three on average. Boundaries depend on the lines around them
only, so a passage is cut alike wherever it stands and whatever is put before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, stored

#: Lines that a chunk has at least, unless its text has fewer.
LEAST_LINES = 2
#: Lines beyond a neighbouring chunk that a match may reach: boundaries farther inside a shared passage are shared.
BEYOND = 3
_PRIME, _MODULUS = 1_000_003, 2_147_483_647


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def with_chunks(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_lines`` (array of lines) and ``_ends`` (numbers of lines that end a chunk, from 1)."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    hashed = docs.withColumn("_lines", lines).withColumn("_hashes", F.transform("_lines", _line_hash))
    rolling = lambda h, k: F.pmod(F.coalesce(F.get("_hashes", k - 1), F.lit(0)) * _PRIME + h, F.lit(_MODULUS))
    rolled = hashed.withColumn("_rolling", F.transform("_hashes", rolling))

    def ends(i: Column) -> Column:
        at = lambda k: F.get("_rolling", i - 1 + k)
        inside = (i >= LEAST_LINES) & (i <= F.size("_lines") - LEAST_LINES)
        return (i == F.size("_lines")) | (inside & (at(0) < at(-1)) & (at(0) < at(1)))

    return rolled.withColumn("_ends", F.filter(F.sequence(F.lit(1), F.size("_lines")), ends)).drop("_hashes", "_rolling")


def _digest(line: Column) -> Column:
    """128 bits of a line's SHA-256."""
    return F.unhex(F.substring(F.sha2(line, 256), 1, 32))


def chunks(docs: DataFrame, sides: bool = False) -> DataFrame:
    """``(doc_id, row, first, n, chunk)`` of each multi-line chunk that has a visible character.

    With ``sides``, also digests of the lines around it: those of the chunk before
    and ``BEYOND`` lines more, the nearest first, in ``before``, and of the chunk
    after in ``after``.
    """
    cut_up = with_chunks(docs.select("doc_id", "text")).withColumn("row", F.xxhash64("text")).withColumn("_n", F.size("_lines"))
    if sides:
        cut_up = cut_up.withColumn("_digests", F.transform("_lines", _digest))
    end = lambda k: F.get("_ends", k)

    def span(e: Column, k: Column) -> Column:
        low = F.greatest(F.coalesce(end(k - 2), F.lit(0)) - BEYOND, F.lit(0))
        high = F.least(F.coalesce(end(k + 1), F.col("_n")) + BEYOND, F.col("_n"))
        return F.struct(F.coalesce(end(k - 1), F.lit(0)).alias("before"), e.alias("last"), low.alias("low"), high.alias("high"))

    each = cut_up.select("doc_id", "row", "_lines", *["_digests"] * sides, F.explode(F.filter(F.transform("_ends", span), lambda s: s["last"] - s["before"] >= LEAST_LINES)).alias("s"))
    size = F.col("s.last") - F.col("s.before")
    text = F.array_join(F.slice("_lines", F.col("s.before") + 1, size), "\n")
    out = [(F.col("s.before") + 1).alias("first"), size.alias("n"), text.alias("chunk")]
    if sides:
        out += [F.reverse(F.slice("_digests", F.col("s.low") + 1, F.col("s.before") - F.col("s.low"))).alias("before"), F.slice("_digests", F.col("s.last") + 1, F.col("s.high") - F.col("s.last")).alias("after")]
    return each.select("doc_id", "row", *out).where(F.col("chunk").rlike(r"\S"))


def _shared(a: Column, b: Column) -> Column:
    """How many values two arrays begin with in common."""
    n = F.least(F.size(a), F.size(b))
    parted = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y), False).cast("int")
    return F.when(parted == 0, n).otherwise(parted - 1)


def repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, first, n)``: runs of lines around chunks whose bytes stand earlier, by doc_id and then line, in some document.

    Chunks are first grouped by a 64-bit hash, which moves no text; those whose
    hash comes twice are then grouped by their own bytes. Both groupings
    pre-aggregate in each task, so a passage of a third of all documents is a row
    a task there. What is joined is stored first, so that both sides of a join
    are plain shuffles, of which Spark splits skewed partitions, and the text of
    repeated chunks is moved and kept once.

    A passage's first and last lines are mostly in chunks with lines of the text
    around it. So a match is extended over the lines before and after the chunk
    as long as they equal those of the occurrence that stays, by 128 bits of
    their SHA-256. Every line that goes stands earlier, and the earliest stays.
    """
    kept_docs = docs.where("doc_id is not null")
    twice = chunks(kept_docs).select(F.xxhash64("chunk").alias("h")).groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h")
    keyed = chunks(kept_docs, sides=True).withColumn("h", F.xxhash64("chunk"))
    maybe = stored(keyed.join(cut(twice), "h"), "chunks")
    kept = F.struct("doc_id", "first", F.col("before").alias("b"), F.col("after").alias("a"))
    earliest = maybe.groupBy("h", "chunk").agg(F.min(kept).alias("kept"), F.count("*").alias("times")).where("times > 1").select("h", "chunk", "kept")
    late = maybe.join(cut(earliest), ["h", "chunk"]).where((F.col("doc_id") != F.col("kept.doc_id")) | (F.col("first") != F.col("kept.first")))
    up, down = _shared(F.col("before"), F.col("kept.b")), _shared(F.col("after"), F.col("kept.a"))
    return late.select("doc_id", "row", (F.col("first") - up).alias("first"), (F.col("n") + up + down).alias("n"))


def remove_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns, repeated multi-line chunks taken out of ``text``, and ``_n_lines`` and ``_n_removed``.

    Of each repeated chunk the occurrence with the smallest doc_id, and in it
    the first, stays; all others go with their lines and with equal lines right
    before and after. The other lines stay as they
    were, joined by newlines. Null texts stay null and have no lines removed;
    empty texts have one empty line; nothing is removed for chunks of blank lines
    or texts of single lines; documents with a null doc_id take no part. Rows that share a
    doc_id keep the chunks that both have first in both.
    """
    at = repeats(docs).groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set(F.struct("first", "n")).alias("_gone"))
    marked = docs.withColumn("_row", F.xxhash64("text")).join(at.withColumnRenamed("_row", "_row2"), (F.col("doc_id") == F.col("_id")) & (F.col("_row") == F.col("_row2")), "left").drop("_id", "_row", "_row2")
    lines = F.split("text", "\n", -1)
    gone = F.array_distinct(F.flatten(F.transform("_gone", lambda g: F.sequence(g["first"], g["first"] + g["n"] - 1))))
    there = marked.withColumn("_lines", lines).withColumn("_out", F.when(F.col("_gone").isNotNull(), gone))
    left = F.transform(F.array_except(F.sequence(F.lit(1), F.size("_lines")), F.col("_out")), lambda i: F.get("_lines", i - 1))
    text = F.when(F.col("_out").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    done = there.withColumn("_n_lines", F.coalesce(F.size("_lines"), F.lit(0)).cast("long")).withColumn("_n_removed", F.coalesce(F.size("_out"), F.lit(0)).cast("long"))
    return done.withColumn("text", text).drop("_lines", "_out", "_gone")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` as ``remove_lines`` leaves it; ``n_chars``, if there, counts the new text where it changed."""
    prepare(docs.sparkSession)
    out = remove_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_removed, text)`` of every document."""
    prepare(docs.sparkSession)
    return remove_lines(docs.select("doc_id", "text")).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), "text")


def _common_sql(a: str, b: str) -> str:
    n = f"least(len({a}), len({b}))"
    return f"coalesce(nullif(list_position(list_transform(range(1, {n} + 1), lambda i: {a}[i] = {b}[i]), false), 0) - 1, {n})"


ORACLE_SQL = f"""
with recursive l as (
  select doc_id, text, string_split(coalesce(text, ''), chr(10)) lines from documents
), h as (
  select doc_id, lines, len(lines) n, list_transform(lines, lambda x: ('0x' || substr(md5(x), 1, 8))::bigint) hs from l where text is not null
), r as (
  select doc_id, lines, n, list_transform(hs, lambda x, k: (coalesce(hs[k - 1], 0) * {_PRIME} + x) % {_MODULUS}) rs from h
), c as (
  select doc_id, lines, n, list_filter(range(1, n + 1), lambda i: i = n or (i between {LEAST_LINES} and n - {LEAST_LINES} and rs[i] < rs[i - 1] and rs[i] < rs[i + 1])) ends from r
), s as (
  select doc_id, lines, unnest(list_transform(ends, lambda e, k: {{'b': coalesce(ends[k - 1], 0), 'e': e, 'lo': greatest(coalesce(ends[k - 2], 0) - {BEYOND}, 0), 'hi': least(coalesce(ends[k + 1], n) + {BEYOND}, n)}})) s from c
), m as (
  select doc_id, s.b + 1 first, s.e last, array_to_string(lines[s.b + 1 : s.e], chr(10)) chunk, list_reverse(lines[s.lo + 1 : s.b]) up, lines[s.e + 1 : s.hi] down from s where s.e - s.b >= {LEAST_LINES}
), k as (
  select doc_id, first, last, up, down, row_number() over w k, first_value(up) over w kup, first_value(down) over w kdown from m where regexp_matches(chunk, '\\S') window w as (partition by chunk order by doc_id, first)
), x as (
  select doc_id, first - {_common_sql("up", "kup")} first, last + {_common_sql("down", "kdown")} last from k where k > 1
), g as (
  select doc_id, list_distinct(flatten(list(range(first, last + 1)))) gone from x group by doc_id
)
select l.doc_id, case when text is null then 0 else len(lines) end::bigint n_lines, coalesce(len(gone), 0)::bigint n_removed,
  case when gone is null then text else array_to_string(list_filter(lines, lambda x, i: not list_contains(gone, i)), chr(10)) end text
from l left join g using (doc_id)
"""
