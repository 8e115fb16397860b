"""Quality rules with thresholds from quantile sketches per language and source.

Every metric is a whole number.  A sketch counts values by bucket: exact below 64, then by a
value's six leading bits, so a bucket is at most 1/32 of its value wide.  Sketches merge by
adding counts, over tasks and over groups: a (language, source) with too few documents takes
the thresholds of its language, that of all documents where even these are few.

An upper fence is q75 + SPREAD * (q75 - q25) plus a slack, and a lower one likewise.  Most
documents repeat nothing, so both quartiles of the repetition rates are 0; their fence is a
quantile from the tail and a share of it instead.  One repetition is no pattern: a document is
held against these fences without its only repeated line, or one repeated phrase of three words,
while the sketches count everything.  Fixed base rules (too few words, too much repetition) come
first; documents they reject don't enter the sketches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquilt.llm.common import NOT_SPACE, SPACE, materialize, quoted

#: Documents that a group must have for thresholds of its own; groups small enough to send to all workers.
LEAST_DOCS, MOST_GROUPS = 200, 200_000
SPREAD = 3
#: A tail fence lies by this part of the quantile above it.
MARGIN = 8


@dataclass(frozen=True)
class Metric:
    name: str
    value: str  # SQL over the base columns, a whole number
    slack: int
    low: bool = False  # has a lower fence too
    tail: int = 0  # percentile that the upper fence is taken from, in place of quartiles
    tested: str = ""  # what is held against the fences, if not the value


METRICS = (
    Metric("word_length", "word_chars * 100 div greatest(n_words, 1)", 150, low=True),
    Metric("symbol_rate", "n_symbols * 10000 div greatest(n_words, 1)", 1000),
    Metric("dup_line_rate", "n_dup_lines * 10000 div greatest(n_lines, 1)", 500, tail=98, tested="if(n_dup_lines = 1, 0, n_dup_lines) * 10000 div greatest(n_lines, 1)"),
    Metric("repeat_rate", "n_repeat_words * 10000 div greatest(n_words, 1)", 500, tail=95, tested="greatest(n_repeat_words - greatest(2 * echo_words, 6), 0) * 10000 div greatest(n_words, 1)"),
)
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with BASE, ``n_lines`` (lines with a word), ``echo_words`` (words of the
    only repeated line, 0 without or with more) and ``base_failed``."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_words", F.array_remove(F.split(body, SPACE), ""))
    out = out.withColumn("_lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(NOT_SPACE)))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    #: Hash of the three words from each position; those that occur twice are found by sorting.
    three = F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))
    out = out.withColumn("_h", F.when(F.size("_words") >= 4, three).otherwise(F.array().cast("array<bigint>")))
    placed = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), placed).otherwise(none))
    twin = F.filter("_s", lambda x, i: F.coalesce(x.h == F.get("_s", i - 1).h, F.lit(False)) | F.coalesce(x.h == F.get("_s", i + 1).h, F.lit(False)))
    out = out.withColumn("_p", F.sort_array(F.transform(twin, lambda x: x.i)))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    marked = F.aggregate("_p", start, lambda a, x: F.struct(x.alias("last"), (a.n + F.least(F.lit(3), x - a.last)).alias("n")), lambda a: a.n)
    out = (
        out.withColumn("word_chars", F.length(F.concat_ws("", "_words")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", marked)
    )
    ordered = F.array_sort("_lines")
    echo = F.get(F.filter(ordered, lambda x, i: x == F.get(ordered, i - 1)), F.lit(0))
    echo = F.size(F.array_remove(F.split(echo, SPACE), "")).cast("long")
    out = out.withColumn("echo_words", F.when(F.col("n_dup_lines") == 1, echo).otherwise(F.lit(0)))
    out = out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    return out.drop("_words", "_lines", "_h", "_s", "_p")


def bucket(value: Column | str) -> Column:
    """A value's bucket, named by its lowest value."""
    shift = f"greatest(length(bin({value})) - 6, 0)"
    return F.expr(f"shiftleft(shiftright({value}, {shift}), {shift})")


def sketches(measured: DataFrame) -> DataFrame:
    """(level, lang, source, metric, bucket, n): mergeable quantile sketches.

    level 2: per language and source; 1: per language; 0: all.  The coarser ones are merged
    from the finest.
    """
    each = F.explode(F.array(*[F.struct(F.lit(m.name).alias("metric"), bucket(f"({m.value})").alias("bucket")) for m in METRICS]))
    rows = measured.where("not base_failed").select("lang", "source", each.alias("x"))
    finest = rows.groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count(F.lit(1)).alias("n"))
    merged = finest.groupingSets([["lang", "source", "metric", "bucket"], ["lang", "metric", "bucket"], ["metric", "bucket"]], "lang", "source", "metric", "bucket")
    return merged.agg(F.sum("n").alias("n"), F.grouping_id().alias("g")).selectExpr("case g when 0 then 2 when 4 then 1 else 0 end as level", "lang", "source", "metric", "bucket", "n")


def quantiles(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, metric, docs, q25, q75, tail) of each sketch."""
    from pyspark.sql import Window

    own = Window.partitionBy("level", "lang", "source", "metric")
    up_to = own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sketch.withColumn("below", F.sum("n").over(up_to)).withColumn("docs", F.sum("n").over(own))
    at = lambda q: F.min(F.when(F.col("below") * 100 >= F.col("docs") * q, F.col("bucket")))
    tail = F.expr("case metric " + " ".join(f"when '{m.name}' then {m.tail}" for m in METRICS) + " end")
    return ranked.groupBy("level", "lang", "source", "metric").agg(F.first("docs").alias("docs"), at(25).alias("q25"), at(75).alias("q75"), at(tail).alias("tail"))


def thresholds(measured: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, <metric>_hi, <metric>_lo...) for every (language, source) there is; keys have '' for null."""
    got = materialize(quantiles(sketches(measured)), "quantiles")

    def wide(level: int, tag: str) -> DataFrame:
        cols = []
        for m in METRICS:
            mine = F.col("metric") == m.name
            cols += [F.max(F.when(mine, F.col("q25"))).alias(f"{tag}{m.name}_q25"), F.max(F.when(mine, F.col("q75"))).alias(f"{tag}{m.name}_q75"), F.max(F.when(mine, F.col("tail"))).alias(f"{tag}{m.name}_tail")]
        return got.where(F.col("level") == level).groupBy("lang", "source").agg(F.max("docs").alias(f"{tag}docs"), *cols)

    fine, mid, top = wide(2, "f_"), wide(1, "m_").drop("source"), wide(0, "t_").drop("lang", "source")
    #: One row of all documents' quantiles goes to all.
    keys = measured.select("lang", "source").distinct()
    rows = keys.join(fine, ["lang", "source"], "left").join(mid, "lang", "left").join(F.broadcast(top), F.lit(True), "left")
    pick = lambda c: F.when(F.col("f_docs") >= least, F.col(f"f_{c}")).when(F.col("m_docs") >= least, F.col(f"m_{c}")).otherwise(F.col(f"t_{c}"))
    out = []
    for m in METRICS:
        low, high = pick(f"{m.name}_q25"), pick(f"{m.name}_q75")
        tail = pick(f"{m.name}_tail")
        upper = F.floor(tail + tail / MARGIN) if m.tail else high + SPREAD * (high - low)
        out.append((upper + m.slack).alias(f"{m.name}_hi"))
        if m.low:
            out.append((low - SPREAD * (high - low) - m.slack).alias(f"{m.name}_lo"))
    return rows.select("lang", "source", *out)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCS, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with BASE, ``base_failed`` and ``kept``.

    A null text has no words and fails.  A null language or source is a group of its own, the
    one of ''.  Rows that repeat count each.  Result columns replace columns of the same name; an
    empty table gives an empty one.  Documents are measured once, into a scratch table; the
    thresholds, one row a group, are sent to all workers only while there are few groups.
    """
    keep = [c for c in (docs.columns if carry is None else carry) if c not in {*BASE, "base_failed", "kept"}]
    rows = docs.select(*[F.col(quoted(c)).alias(f"in_{i}") for i, c in enumerate(keep)], F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"))
    measured = materialize(base_metrics(rows).drop("text"), "measured")
    limits = materialize(thresholds(measured, least), "thresholds")
    if limits.count() <= MOST_GROUPS:
        limits = F.broadcast(limits)
    tests = [F.expr(f"{m.tested or m.value} <= {m.name}_hi" + f" and {m.tested or m.value} >= {m.name}_lo" * m.low) for m in METRICS]
    passed = tests[0]
    for t in tests[1:]:
        passed = passed & t
    out = measured.join(limits, ["lang", "source"], "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(passed, F.lit(True)))
    return out.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(keep)], *BASE, "base_failed", "kept")


def clean(docs: DataFrame, **options) -> DataFrame:
    """The kept rows, with their own columns."""
    return judge(docs, **options).where("kept").select(*[quoted(c) for c in docs.columns])
