"""Quality rules whose cutoffs adapt to each language and source, by mergeable quantile sketches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, column, cut, mapped, prepare, slices, utf8
from .textstats import counts

#: What is judged, all from above.
RULES = ("symbols", "dup_lines", "repeats", "word_len")
#: What three of the ratios are shares of: characters of words, lines and four more, words.
SIZES = {"symbols": "n_chars", "dup_lines": "n_lines", "repeats": "n_words"}
#: So many units come together by chance: three symbols, one line, the words of three windows and of their twins.
CHANCE = {"symbols": 3.0, "dup_lines": 1.0, "repeats": 18.0}
#: A fence lies so many spreads above the median.
REACH = 6.0
#: A source's fence may lie so many times farther from the median than its language's and all documents', but not beyond.
LIFT = 2.0
#: Documents that a language and source need for fences of their own; below, the language's, then all documents'.
ENOUGH = 200
#: Groups whose fences are broadcast: a row of some 100 bytes each.
SENT = 50_000
#: Relative accuracy of a sketch, and the values from which it tells values apart.
ACCURACY, LEAST, MOST = 0.01, 1e-4, 1e9
_GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_FIELDS = [T.StructField(f"_q_{k}", T.LongType()) for k in BASE] + [T.StructField("_q_base_failed", T.BooleanType())] + [T.StructField(f"_q_{k}", T.DoubleType()) for k in RULES] + [T.StructField(f"_q_s_{k}", T.DoubleType()) for k in SIZES]


def with_counts(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``docs``, or the columns ``keep`` of it, with what the rules need of each text in columns ``_q_*``."""
    plain = docs.select(*(F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)), F.col(text).cast("string").alias("_q_text"))
    fields = [f for f in plain.schema if f.name != "_q_text"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_q_text", SLICE_BYTES >> 2):
                c = counts(*utf8(column(part, "_q_text")))
                w, n, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), c["n_lines"] + 4
                own = [pa.array(c[k].astype(np.int64)) for k in BASE] + [pa.array(c["base_failed"])]
                own += [pa.array(x) for x in (c["n_symbols"] / n, c["n_dup_lines"] / lines, c["n_repeat_words"] / w, c["word_chars"] / w)]
                own += [pa.array(x.astype(np.float64)) for x in (n, lines, w)]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(fields))] + own, names=[f.name for f in fields] + [f.name for f in _FIELDS])

    return mapped(plain, run, T.StructType(fields + _FIELDS))


def _bucket(x: Column) -> Column:
    """The sketch's bucket of a value: 0 for tiny ones, else one of about 1,500 on a logarithmic scale."""
    clipped = F.least(x, F.lit(MOST))
    return F.when(clipped <= LEAST, F.lit(0)).otherwise(F.ceil(F.log(clipped / LEAST) / F.log(F.lit(_GAMMA)))).cast("int")


def _value(b: Column) -> Column:
    return F.when(b <= 0, F.lit(0.0)).otherwise(F.lit(LEAST) * F.pow(F.lit(_GAMMA), b) * 2 / (1 + _GAMMA))


def sketches(measured: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, rule, bucket, n)``: a quantile sketch for each group and rule, and for each size, as counts of logarithmic buckets.

    Sketches merge by adding counts, so the result is the same however rows are
    dealt out or tasks run again. A group has at most some thousand rows.
    """
    every = [*RULES, *(f"s_{k}" for k in SIZES)]
    rules = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), _bucket(F.col(f"_q_{k}")).alias("bucket")) for k in every))).alias("r")
    # of the base rules' rejects nothing is learnt
    return measured.where("not _q_base_failed").select(*by, rules).groupBy(*by, "r.rule", "r.bucket").agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, total, mid_<rule>..., reach_<rule>...)``: each group's medians, and how far above them its fences lie."""
    from pyspark.sql import Window

    each = sketch.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "rule")
    running = each.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), F.col("bucket")))
    marks = running.groupBy(*by, "rule").agg(F.max("total").alias("total"), _value(at(0.5)).alias("mid"), _value(at(0.1)).alias("low"), _value(at(0.75)).alias("high"))
    marks = marks.withColumn("spread", F.greatest(F.col("mid") - F.col("low"), F.col("high") - F.col("mid")))
    of = lambda rule, c: F.max(F.when(F.col("rule") == rule, F.col(c)))
    spread = {k: F.greatest(of(k, "spread"), F.lit(CHANCE[k]) / of(f"s_{k}", "mid")) if k in SIZES else of(k, "spread") for k in RULES}
    return marks.groupBy(*by).agg(F.max("total").alias("total"), *(of(k, "mid").alias(f"mid_{k}") for k in RULES), *((REACH * v).alias(f"reach_{k}") for k, v in spread.items()))


def fences(sketch: DataFrame) -> DataFrame:
    """``(_q_lang, _q_source, _f_<rule>...)`` from the sketches of each language and source; small groups get the language's fences or all documents'."""
    named = lambda df, p, *by: df.select(*by, *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in by))
    own = _fences(sketch, ["_q_lang", "_q_source"])
    lang = named(_fences(sketch, ["_q_lang"]), "l", "_q_lang")
    every = named(_fences(sketch.withColumn("_q_all", F.lit(1)), ["_q_all"]).drop("_q_all"), "a")
    both = own.join(lang, "_q_lang").join(F.broadcast(every))  # one row
    of_lang = F.col("l_total") >= ENOUGH

    def fence(k: str) -> Column:
        at = lambda p, times=1.0: F.col(f"{p}mid_{k}") + times * F.col(f"{p}reach_{k}")
        most = F.greatest(at("a_", LIFT), F.when(of_lang, at("l_", LIFT)))  # a null is left out
        return F.least(F.when(F.col("total") >= ENOUGH, at("")).when(of_lang, at("l_")).otherwise(at("a_")), most)

    return both.select("_q_lang", "_q_source", *(fence(k).alias(f"_f_{k}") for k in RULES))


def _keyed(df: DataFrame) -> DataFrame:
    """Language and source as keys, null as a value of its own."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) if c in df.columns else F.lit("")
    return df.withColumns({"_q_lang": key("lang"), "_q_source": key("source")})


def _failed() -> Column:
    """The rules that a document fails, comma-joined: ``base`` alone, or those whose fences it is beyond."""
    beyond = [F.when(F.col(f"_q_{k}") > F.col(f"_f_{k}"), F.lit(k)) for k in RULES]
    return F.when(F.col("_q_base_failed"), F.lit("base")).otherwise(F.concat_ws(",", *beyond))


def judge(measured: DataFrame, sketch: DataFrame) -> DataFrame:
    """``measured`` (of ``with_counts``) with ``failed`` and ``kept``: within the base rules and the fences of its language and source.

    Up to ``SENT`` groups' fences are sent to the tasks, so no text moves; more
    are joined by a shuffle.
    """
    keyed, marks = _keyed(measured), cut(fences(sketch))
    marks = F.broadcast(marks) if marks.count() <= SENT else marks
    return keyed.join(marks, ["_q_lang", "_q_source"], "left").withColumn("failed", _failed()).withColumn("kept", F.col("failed") == "")


def quality_rules(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed)`` of every document.

    Base: fewer than 50 words, or over half of the words in three-word windows
    that the text repeats. The others are judged by four ratios (symbols to word
    characters, repeated lines to all lines and four more, repeated words, word
    length), whose fences are read off quantile sketches of their language and
    source: ``REACH`` spreads above the median a document goes. The spread is the
    farther of the tenth percentile and the upper quartile, and at least what
    ``CHANCE`` units are in a document of the group's median size, as ratios that
    most documents have at zero have no spread. A fence is bounded by the
    language's and all documents' (``LIFT``), so a source full of junk doesn't
    lift its own. ``failed`` names the rules that a document fails.

    Null texts are empty and so fail the base; null languages and sources are
    groups of their own; a missing column is one group; repeated rows are judged
    alike; no documents give no rows.
    """
    prepare(docs.sparkSession)
    keep = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    measured = cut(with_counts(docs, keep))
    judged = judge(measured, sketches(_keyed(measured), ["_q_lang", "_q_source"]))
    return judged.select("doc_id", *(F.col(f"_q_{k}").alias(k) for k in BASE), F.col("_q_base_failed").alias("base_failed"), "kept", "failed")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that ``quality_rules`` keeps, whole and with all their columns.

    Texts are measured twice, for the sketches and for the verdicts, rather than
    shuffled to meet their verdict.
    """
    prepare(docs.sparkSession)
    keep = [c for c in ("lang", "source") if c in docs.columns]
    sketch = cut(sketches(_keyed(with_counts(docs, keep)), ["_q_lang", "_q_source"]))
    return judge(with_counts(docs), sketch).where("kept").select(*(F.col(f"`{c}`") for c in docs.columns))


_WORD, _GAP = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]+"


def _oracle() -> str:
    value = lambda q: f"coalesce(case when min(bucket) filter (upto >= ceil(total * {q})) > 0 then {LEAST} * pow({_GAMMA!r}, min(bucket) filter (upto >= ceil(total * {q}))) * 2 / {1 + _GAMMA!r} end, 0.0)"
    of = lambda k, c: f"max({c}) filter (rule = '{k}')"
    spread = lambda k: f"greatest({of(k, 'greatest(mid - low, high - mid)')}, {CHANCE[k]} / {of('s_' + k, 'mid')})" if k in SIZES else of(k, "greatest(mid - low, high - mid)")
    wide = ", ".join(f"{of(k, 'mid')} mid_{k}, {REACH} * {spread(k)} reach_{k}" for k in RULES)

    def group(name: str, by: str) -> str:
        keys = f"{by}, " if by else ""
        return f"""{name}_e as (select {keys}rule, bucket, count(*) n from bk group by all),
{name}_r as (select *, sum(n) over (partition by {keys}rule order by bucket) upto, sum(n) over (partition by {keys}rule) total from {name}_e),
{name}_m as (select {keys}rule, max(total) total, {value(0.5)} mid, {value(0.1)} low, {value(0.75)} high from {name}_r group by {keys}rule),
{name} as (select {keys}max(total) total, {wide} from {name}_m{f' group by {by}' if by else ''})"""

    def fence(k: str) -> str:
        at = lambda p, times=1.0: f"{p}.mid_{k} + {times} * {p}.reach_{k}"
        return f"least(case when o.total >= {ENOUGH} then {at('o')} when l.total >= {ENOUGH} then {at('l')} else {at('a')} end, greatest({at('a', LIFT)}, case when l.total >= {ENOUGH} then {at('l', LIFT)} end)) f_{k}"

    ratios = {"symbols": "n_symbols / greatest(word_chars, 1)", "dup_lines": "n_dup_lines / (n_lines + 4)", "repeats": "n_repeat_words / greatest(n_words, 1)", "word_len": "word_chars / greatest(n_words, 1)"}
    ratios |= {"s_symbols": "greatest(word_chars, 1)::double", "s_dup_lines": "(n_lines + 4)::double", "s_repeats": "greatest(n_words, 1)::double"}
    beyond = ", ".join(f"case when {ratios[k]} > f_{k} then '{k}' end" for k in RULES)
    bucket = lambda v: f"case when least({v}, {MOST}) <= {LEAST} then 0 else ceil(ln(least({v}, {MOST}) / {LEAST}) / ln({_GAMMA!r}))::int end"
    return f"""
with t as (
  select doc_id, coalesce(lang, '') || case when lang is null then '0' else '1' end lg, coalesce(source, '') || case when source is null then '0' else '1' end sc, coalesce(text, '') text from documents
), w as (
  select *, regexp_extract_all(text, '{_WORD}+') w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) ls from t
), g as (
  select doc_id, i, array_to_string(w[i : i + 2], ' ') k from (select doc_id, w, unnest(range(1, len(w) - 1)) i from w)
), again as (
  select doc_id, count(distinct place) n from (select doc_id, unnest(range(i, i + 3)) place from g where (doc_id, k) in (select (doc_id, k) from g group by doc_id, k having count(*) > 1)) group by doc_id
), c as (
  select w.doc_id, lg, sc, len(w)::bigint n_words, length(regexp_replace(text, '{_GAP}', '', 'g'))::bigint word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, len(ls) n_lines, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(n, 0)::bigint n_repeat_words from w left join again using (doc_id)
), b as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from c
), bk as (
  select lg, sc, v.rule as rule, {bucket("v.x")} bucket from (select lg, sc, unnest([{", ".join(f"{{'rule': '{k}', 'x': {v}}}" for k, v in ratios.items())}]) v from b where not base_failed)
), {group("o", "lg, sc")}, {group("l", "lg")}, {group("a", "")},
f as (select o.lg, o.sc, {", ".join(fence(k) for k in RULES)} from o join l on o.lg = l.lg, a),
r as (select b.*, case when base_failed then 'base' else concat_ws(',', {beyond}) end failed from b left join f on b.lg = f.lg and b.sc = f.sc)
select doc_id, {", ".join(BASE)}, base_failed, failed = '' kept, failed from r
"""


ORACLE_SQL = _oracle()
