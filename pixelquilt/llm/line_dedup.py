"""Line dedup by an exact set-similarity join of lines.

A line is the set of its distinct words, in lower case.  Equal sets are one class, known by two
hashes, and first seen at its smallest place (document, line); lines without a word are left out.
A class's words are ordered by rarity; of two classes with Jaccard similarity num/den or more

* the sizes are close (length filter),
* the first shared word is among the first few of both (prefix filter),
* the words from there on are enough for the overlap they need (positional filter), and
* the parities of their words' hash bits differ in no more places than the sets do.

A line goes if its class was seen before, or if a similar class was seen before its own; all of
this whether or not the earlier line stays itself.

Words are hashed once, into a scratch table that serves counts and classes and is dropped then;
verification hashes the words of asked lines again.  A word's rarity is read from a table of ``ROWS`` times
``SLOTS`` counts over all lines: its size is fixed, and any one order of words gives the same result.

Candidates are looked for by (word, size band).  Where more than ``FEW`` classes share a key they
are first compared with two of them, the earliest and the one with most copies; only those
without a match by then are paired with the others, so near copies of one line cost two
comparisons each.  A key that more than ``HOT`` classes share is split by the next shared word,
up to ``WORDS`` words: the k-th shared word is among the first few and k - 1 more of both.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, IntegerType, LongType, ShortType, StringType

from pixelquilt.llm.common import NOT_SPACE, Scratch, quoted

#: The rarity table, whatever the input; it is the one thing that goes to all tasks.  Counted as rows of
#: so many slots, as a task's map of no more than ROWS keys stays in the fast part of Spark's aggregation.
ROWS, SLOTS = 1 << 16, 1 << 3
BUCKETS = ROWS * SLOTS
#: Bits of a word's hash that its place in the order has; a level stands above them.
BITS = 48
#: Classes under one key up to which all pairs are compared at once, and beyond which the key is split.
FEW, HOT = 32, 2048
#: Distinct words beyond which a line has parities of four times as many bits; 64 tell such lines apart no longer.
LONG = 160
#: Words that a key may be made of.
WORDS = 3
#: Lines to be verified that may be named to all tasks (some 60 bytes each); more are joined by shuffle.
ASKED = 200_000


def _lines(text: str) -> Column:
    """A text's lines, with blanks for other white space."""
    body = F.coalesce(text, F.lit(""))
    other = body.contains("\t") | body.contains("\x0b") | body.contains("\x0c") | body.contains("\r")
    return F.split(F.when(other, F.regexp_replace(body, r"[\x09\x0B-\x0D]", " ")).otherwise(body), "\n")


def _hashes(line: Column) -> Column:
    """Hashes of a line's distinct words in lower case, made so a line at a time: those in ASCII alone cost little."""
    return F.array_remove(F.array_distinct(F.transform(F.split(F.lower(line), " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _word_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, h, line, c1, c2, words) of every line with a word: h is a hash of the text, words the
    sorted hashes of the line's words, c1 and c2 two hashes of these."""
    #: The text is hashed once and not carried along with each of its lines.
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), _lines("text").alias("lines"))
    lines = texts.select("doc_id", "h", F.posexplode("lines").alias("line", "s")).where(F.trim("s") != "")
    rows = lines.select("doc_id", "h", "line", F.sort_array(_hashes(F.col("s"))).alias("words"))
    return rows.select("doc_id", "h", "line", F.xxhash64("words", F.lit(1)).alias("c1"), F.xxhash64(F.lit(2), "words").alias("c2"), "words")


def rarity_levels(lines: DataFrame) -> list[str]:
    """For each bucket of word hashes a level from 0 to 127 that grows with the words' count over all lines."""
    words = lines.select(F.explode("words").alias("w"))
    words = words.select(F.col("w").bitwiseAND(ROWS - 1).cast("int").alias("b"), F.col("w").bitwiseAND(BUCKETS - ROWS).cast("int").alias("slot"))
    counts = words.groupBy("b").agg(*[F.count(F.when(F.col("slot") == i * ROWS, 1)).alias(f"n{i}") for i in range(SLOTS)])
    levels = F.concat_ws(",", *[F.least(F.lit(127), (3 * F.log2(1 + F.col(f"n{i}"))).cast("int")) for i in range(SLOTS)])
    out = ["0"] * BUCKETS
    for b, of in counts.select("b", levels).collect():  # ROWS rows at most
        out[b::ROWS] = of.split(",")
    return out


def _level_table(spark: SparkSession, levels: list[str]) -> Column:
    """The levels above their place in the order, an array by bucket.  A subquery, whose value is no part of
    the plan: as a literal the driver would fold it, and write it out with each description of a plan."""
    table = spark.createDataFrame([(",".join(levels),)], "levels string").select(F.split("levels", ",").cast("array<bigint>").alias("levels"))
    return table.select(F.transform("levels", lambda x: F.shiftleft(x, BITS))).scalar()


def _by_rarity(words: str, levels: str) -> Column:
    """Words, rarest first: numbers made of a word's level and its hash."""
    level = lambda w: F.get(levels, w.bitwiseAND(BUCKETS - 1))
    #: Never null, so that the array is sorted as plain numbers.
    return F.sort_array(F.transform(words, lambda w: F.coalesce(level(w).bitwiseOR(w.bitwiseAND((1 << BITS) - 1)), F.lit(0).cast("long"))))


class Similarity:
    """SQL for the filters at num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        #: Similar sets that aren't equal share this many words at least, so keys may have as many.
        self.shared = max(1, num // (den - num)) if num < den else 1

    def least(self, n: str) -> str:
        """The smallest size of a set similar to one of size n."""
        return f"(({n}) * {self.num} + {self.den - 1}) div {self.den}"

    def overlap(self, n: str, m: str) -> str:
        """The words that similar sets of these sizes share at least."""
        return f"((({n}) + ({m})) * {self.num} + {self.num + self.den - 1}) div {self.num + self.den}"

    def prefix(self, n: str) -> str:
        return f"cast(({n}) - {self.least(n)} + 1 as int)"

    def band(self, n: str) -> str:
        """Sizes by powers of (den/num)^4: a set's similar smaller ones lie in its band or the next below."""
        return f"cast(floor(ln({n}) / {4 * math.log(self.den / self.num)!r}) as int)"

    def fits(self, depth: int) -> str:
        """Of rows a and b: length filter, positional filter for a last shared word of the key at these
        positions (from 0; it is the ``depth``-th shared word), and the filter by parities."""
        n, m, both = _n("a"), _n("b"), self.num + self.den
        least = f"({n} + {m}) * {self.num}"
        #: Products in place of quotients, as pairs are many; sets of these sizes that differ in x words share (n + m - x) / 2.
        near = lambda x: f"({n} + {m} - ({x})) * {both} >= 2 * {least}"
        places = f"(least({n} - {_at('a')}, {m} - {_at('b')}) + {depth - 1}) * {both} >= {least}"
        #: Null where either line is not long; the fourth quarter is what is left of all words' parities.
        quarters = [f"bit_count(a.odd.p{i} ^ b.odd.p{i})" for i in (1, 2, 3)] + ["bit_count(a.sig ^ a.odd.p1 ^ a.odd.p2 ^ a.odd.p3 ^ b.sig ^ b.odd.p1 ^ b.odd.p2 ^ b.odd.p3)"]
        return f"{near('bit_count(a.sig ^ b.sig)')} and least({n}, {m}) * {self.den} >= greatest({n}, {m}) * {self.num} and {places} and coalesce({near(' + '.join(quarters))}, true)"


def _spot(n: str, at: str, home: str) -> Column:
    """Size of a set, position of a word in it and the bit ``home`` as one number, as rows are many."""
    return F.expr(f"shiftleft(cast({n} as bigint), 32) | shiftleft(cast({at} as bigint), 1) | cast({home} as bigint)")


def _n(row: str) -> str:
    return f"shiftright({row}.spot, 32)"


def _at(row: str) -> str:
    return f"shiftright({row}.spot & 4294967295, 1)"


def _classes(lines: DataFrame, levels: list[str], sim: Similarity) -> DataFrame:
    """(c1, c2, first, n, copies, sig, odd, words): words being the prefix and WORDS - 1 more; sig: the
    parities of all words; odd: those of three quarters of the words apart, for long lines alone."""
    one = F.expr("aggregate(words, 0L, (a, w) -> a ^ shiftleft(1L, cast(w & 63 as int)))")
    quarter = [F.expr(f"aggregate(words, 0L, (a, w) -> if((w & 192) = {64 * i}, a ^ shiftleft(1L, cast(w & 63 as int)), a))").alias(f"p{i}") for i in (1, 2, 3)]
    odd = F.when(F.size("words") > LONG, F.struct(*quarter)).alias("odd")
    #: Smaller classes have no other set that is similar, and need neither.
    able = F.expr(f"size(words) * {sim.den} >= (size(words) + 1) * {sim.num}")
    #: The table has a name as lambdas take no subquery; Spark puts it where it is used, once, so no row carries it.
    rows = lines.select("*", _level_table(lines.sparkSession, levels).alias("levels"))
    rows = rows.select("c1", "c2", F.struct("doc_id", "h", "line").alias("place"), F.size("words").alias("n"), F.when(able, one).otherwise(F.lit(0).cast("long")).alias("sig"), odd, F.when(able, _by_rarity("words", "levels")).otherwise(F.array().cast("array<bigint>")).alias("words"))
    rows = rows.withColumn("words", F.expr(f"slice(words, 1, {sim.prefix('n')} + {WORDS - 1})"))
    #: Rows of one class differ in their place alone.
    return rows.groupBy("c1", "c2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "sig", "odd", "words")])


def _shared(rows: DataFrame) -> DataFrame:
    """The rows of keys that more than one class has, one of them in its own band; k: how many."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max(F.expr("spot & 1")).alias("homes")).where("k > 1 and homes = 1").select("key", "k")
    return rows.join(sizes.hint("shuffle_hash"), "key")


def _order(kind: DataType) -> Column:
    """A number that is no smaller for a later document: whole numbers themselves, of texts the first
    seven bytes; others are told apart by the exact comparison at the end alone."""
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        return F.col("first.doc_id").cast("long")
    if isinstance(kind, StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode("first.doc_id", "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    return F.when(F.col("first.doc_id").isNotNull(), F.lit(0).cast("long"))


def _keyed(able: DataFrame, sim: Similarity) -> DataFrame:
    """(key, c1, spot, o, copies, sig, odd): a row for each (word of the prefix, band); o is the number
    of a class's first document.  spot's home: in its own band, and among the few words in which the
    smaller of two similar sets has the first shared one."""
    order = F.coalesce(_order(able.schema["first"].dataType["doc_id"].dataType), F.lit(-(1 << 63))).alias("o")
    #: A class asks for the smaller ones in its own band and in the one below, if that has sizes large enough.
    bands = F.expr(f"sequence({sim.band(sim.least('n'))}, {sim.band('n')})")
    own = able.select("c1", "n", order, "copies", "sig", "odd", F.expr(f"slice(words, 1, {sim.prefix('n')})").alias("words"), F.explode(bands).alias("band"))
    #: What all words of a class have in common is worked out once.
    own = own.withColumn("homes", F.expr(f"if(band = {sim.band('n')}, n - {sim.overlap('n', 'n')}, -1)"))
    rows = own.select("c1", "n", "o", "copies", "sig", "odd", "band", "homes", F.posexplode("words").alias("at", "w"))
    return rows.select(F.xxhash64("w", "band").alias("key"), "c1", _spot("n", "at", "(at <= homes)").alias("spot"), "o", "copies", "sig", "odd")


def _split(hot: DataFrame, able: DataFrame, sim: Similarity, depth: int) -> DataFrame:
    """The rows again under keys of one word more than ``depth``."""
    rows = hot.alias("hot").join(able.select("c1", "words"), "c1").select("hot.*", "words", F.expr(f"cast({_n('hot')} as int)").alias("n"), F.expr(f"cast({_at('hot')} as int)").alias("at"))
    later = F.posexplode(F.expr(f"slice(words, at + 2, greatest({sim.prefix('n')} + {depth} - at - 1, 0))")).alias("j", "v")
    return rows.select("*", later).select(F.xxhash64("key", "v").alias("key"), "c1", _spot("n", "at + 1 + j", "(spot & 1)").alias("spot"), "o", "copies", "sig", "odd")


def _pairs(asking: DataFrame, told: DataFrame, sim: Similarity, depth: int = 1, once: bool = False) -> DataFrame:
    """(c1, d1): classes under one key of ``depth`` words that pass all filters, d1 not in a later
    document; once: where no key has many rows, which needs no sort."""
    #: The same columns on either side, so that a table joined with itself is shuffled once.
    own = ["key", "c1", "spot", "o", "sig", "odd"]
    met = asking.select(*own).alias("a").join(told.select(*own).hint("shuffle_hash").alias("b") if once else told.select(*own).alias("b"), F.expr("a.key = b.key"))
    met = met.where(F.expr("a.c1 <> b.c1 and b.o <= a.o and (a.spot | b.spot) & 1 = 1") & F.expr(sim.fits(depth)))
    return met.select(F.col("a.c1").alias("c1"), F.col("b.c1").alias("d1"))


def _to_anchors(told: DataFrame, sim: Similarity) -> DataFrame:
    """(c1, d1): each class with the earliest under its key, and with the one that has most copies."""
    own = ["c1", "spot", "sig", "odd", "o"]
    anchors = told.groupBy("key").agg(F.min(F.struct("o", "c1", "spot", "sig", "odd")).alias("e"), F.max(F.struct("copies", *own)).alias("f"))
    anchors = anchors.select("key", F.explode(F.array(*[F.struct(*[F.col(f"{x}.{c}").alias(c) for c in own]) for x in ("e", "f")])).alias("x"))
    #: An anchor answers wherever it stands.
    anchors = anchors.select("key", *[F.col(f"x.{c}").alias(c) for c in own]).withColumn("spot", F.expr("spot | 1"))
    return _pairs(told, anchors, sim)


def _similar(pairs: DataFrame, able: DataFrame, docs: DataFrame, sim: Similarity, scratch: Scratch) -> DataFrame:
    """(c1, c2) of the classes that have a similar earlier one among their pairs (c1, d1)."""
    asked = pairs.select("c1").union(pairs.select(F.col("d1").alias("c1"))).distinct()
    asked = scratch.write(able.select("c1", "c2", "first").join(asked, "c1", "left_semi"), "asked")
    by_doc = asked.groupBy(F.col("first.doc_id").alias("at_doc"), F.col("first.h").alias("at_h")).agg(F.collect_list(F.struct("c1", "c2", "first")).alias("asked"))
    by_doc = F.broadcast(by_doc) if asked.count() <= ASKED else by_doc.hint("shuffle_hash")
    #: Rows that repeat an id and a text are there as often.
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").join(by_doc, F.col("doc_id").eqNullSafe(F.col("at_doc")) & (F.col("h") == F.col("at_h")))
    lines = texts.select("asked", _lines("text").alias("lines"))
    #: Each asked line goes on with its own words alone.
    lines = lines.select(F.explode(F.transform("asked", lambda x: F.struct(x["c1"].alias("c1"), x["c2"].alias("c2"), x["first"].alias("first"), F.get("lines", x["first"]["line"]).alias("line")))).alias("x"))
    sets = lines.select("x.c1", "x.c2", "x.first", _hashes(F.col("x.line")).alias("words"))
    sets = scratch.write(sets, "sets", "orc")
    other = sets.select(F.col("c1").alias("d1"), F.col("first").alias("earlier"), F.col("words").alias("others"))
    both = pairs.join(sets, "c1").join(other, "d1").where(F.col("earlier") < F.col("first"))
    tested = both.select("c1", "c2", (F.size("words") + F.size("others")).alias("total"), F.size(F.array_intersect("words", "others")).alias("both"))
    found = scratch.write(tested.where(f"{sim.den} * both >= {sim.num} * (total - both)").select("c1", "c2").distinct(), "similar")
    scratch.drop(asked, sets)
    return found


def removed(docs: DataFrame, num: int = 9, den: int = 10) -> DataFrame:
    """(doc_id, h, gone): per document (id and hash of its text) the numbers of the lines that go."""
    scratch, sim = Scratch(docs.sparkSession, "lines"), Similarity(num, den)
    docs = docs.select("doc_id", "text")
    lines = scratch.write(_word_sets(docs), "words", "orc")
    classes = scratch.write(_classes(lines, rarity_levels(lines), sim), "classes")
    placed = scratch.write(lines.select("c1", "c2", F.struct("doc_id", "h", "line").alias("place")), "places")
    scratch.drop(lines)
    #: Smaller classes have no other set that is similar.
    able = classes.where(f"n * {den} >= (n + 1) * {num}")
    told = scratch.write(_shared(_keyed(able, sim)), "keys")

    few, many = told.where(f"k <= {FEW}"), told.where(f"k > {FEW}")
    near = scratch.write(_pairs(few, few, sim, once=True).union(_to_anchors(many, sim)).distinct(), "pairs")
    found = _similar(near, able, docs, sim, scratch)
    asking = many.drop("k").join(found.select("c1"), "c1", "left_anti")
    answering, parts = many, []
    hot = many.where(f"k > {HOT}").select("key").distinct()
    for depth in range(1, WORDS + 1):
        if depth >= min(WORDS, sim.shared) or hot.isEmpty():
            parts.append(_pairs(asking, answering, sim, depth))
            break
        parts.append(_pairs(asking.join(hot, "key", "left_anti"), answering, sim, depth))
        asking = scratch.write(_split(asking.join(hot, "key", "left_semi"), able, sim, depth), "asking")
        answering = _split(answering.drop("k").join(hot, "key", "left_semi"), able, sim, depth)
        #: Keys under which nobody asks are done with.
        answering = scratch.write(answering.join(asking.select("key").distinct(), "key", "left_semi"), "answering")
        hot = answering.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where(f"k > {HOT}").select("key")
    more = reduce(DataFrame.union, parts)
    more = scratch.write(more.distinct().join(near, ["c1", "d1"], "left_anti"), "pairs")
    found = found.union(_similar(more, able, docs, sim, scratch)).distinct()

    marks = classes.select("c1", "c2", "first", "copies").join(found.withColumn("hit", F.lit(True)), ["c1", "c2"], "left").where("copies > 1 or hit").select("c1", "c2", "first", "hit")
    gone = placed.join(marks.hint("shuffle_hash"), ["c1", "c2"]).where((F.col("place") != F.col("first")) | F.col("hit"))
    gone = gone.select(F.col("place.doc_id").alias("doc_id"), F.col("place.h").alias("h"), "place.line").distinct().groupBy("doc_id", "h").agg(F.sort_array(F.collect_list("line")).alias("gone"))
    gone = scratch.keep(scratch.write(gone, "gone"))
    scratch.drop()
    return gone


def dedup(docs: DataFrame, num: int = 9, den: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the later of similar lines taken out of ``text``, and ``n_lines``, ``gone`` (the
    numbers of the lines that went, from 0).

    Places are ordered by (doc_id, hash of the text, line), null ids first; rows that agree in both
    are one document and come out alike.  A null text stays null and has no lines; an empty one has
    one line, which stays.  Lines without a word stay.  Texts and lines of any length are taken
    whole.  Result columns replace columns of the same name; other columns may have any name; an
    empty table gives an empty one.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "gone")]
    gone = removed(docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text")), num, den)
    rows = docs.select(*[F.col(quoted(c)).alias(f"in_{i}") for i, c in enumerate(keep)], F.col(quoted(doc_id)).alias("own_id"), F.xxhash64(F.col(quoted(text))).alias("own_h"))
    rows = rows.join(gone.hint("shuffle_hash"), F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_h") == F.col("h")), "left")
    body = F.col(f"in_{keep.index(text)}")
    lines = F.split(body, "\n")
    n_lines = F.coalesce(F.when(body.isNotNull(), F.size(lines)), F.lit(0)).cast("long")
    stays = F.filter(lines, lambda x, i: ~F.array_contains("gone", i))
    left = F.when(F.col("gone").isNotNull(), F.array_join(stays, "\n")).otherwise(body)
    own = [(left if c == text else F.col(f"in_{i}")).alias(c) for i, c in enumerate(keep)]
    return rows.select(*own, n_lines.alias("n_lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))


def clean(docs: DataFrame, num: int = 9, den: int = 10) -> DataFrame:
    """The documents without the lines that go, and without documents that lost their last word by it.

    ``n_chars`` follows the text; all else is as in ``dedup``.
    """
    out = dedup(docs, num, den).where((F.size("gone") == 0) | F.col("text").rlike(NOT_SPACE))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*[quoted(c) for c in docs.columns])
