"""N-gram Jaccard join by PartEnum signatures.

A document's set is its distinct word shingles.  Sizes fall into bands.  In a band, two sets
that are similar enough differ in at most k elements.  The hashed feature domain is cut in two
levels: of the first-level parts, more than ``spare`` see at most ``errors`` of the differing
elements; in each of them the subsets that leave out ``errors`` second-level parts are
enumerated, and every subset's content is a signature.  So at least one signature of a similar
pair is the same.  Sets near a band's lower end also sign for the next band, so every similar pair
shares a signature in the band of its larger set.  Signatures of few elements would be those of
many sets that are not similar, and their number of pairs would grow with its square: a set leaves
out all that have fewer than it can do without.  A set of its size and any similar one agree in so
many first-level parts at least; it may have a weaker signature in one part less.  That holds for
the stricter set of a pair as well, so a part stays that both sign.  Candidates of one signature whose sizes or
parities of hashed elements differ too much are no pairs; the others are verified on the whole sets.

Groups of equal sets are one node from the start.  In a signature's group every node is first
compared with one anchor; nodes that are linked by then need no comparison with each other,
and only pairs between different components are still enumerated.  So a group of n near
copies costs n comparisons, not n squared, and no link between components is lost.

Signatures are made anew in each of the two scans that shuffle them, and never stored: one finds
those that different sets share, the other brings these sets together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquilt.llm.common import LOWER, WHITE, Scratch, materialize, mix64, quoted, text_slices, tidy, word_hashes
from pixelquilt.llm.components import components

_U = np.uint64
#: Elements that a signature should cover on average in the smallest set of a band.
COVER = 3
#: Rounds with anchors before pairs between components are enumerated, and how many pairs a row may cost.
ROUNDS, PAIRS_A_ROW = 6, 512
#: Shares of the signatures that are shuffled one after another: each takes as much less of the disk.
PASSES = 2
#: 64-bit words of a set's parities: of two sets, no more bits differ than elements.  A few of them
#: serve within groups, the others for pairs: a power of two, and a bit an element where sets are larger.
PARITIES, MORE_PARITIES = 8, 32
#: Parts or bits of sets that are counted at once.
CELLS = 1 << 18
#: Ids of candidates up to which they go to all tasks (some 50 bytes each); more are joined by shuffle.
FEW_IDS = 200_000


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, at): the sorted distinct 64-bit hashes of each text's shingles of ``size`` words, one text after
    another, and the offset of each text's first (n+1 values); a text of fewer words is one shingle."""
    h, first = word_hashes(LOWER[data], bounds, WHITE)
    n = max(0, len(h) - size + 1)
    mixed = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        mixed = mix64(mixed * _U(0x9E3779B97F4A7C15) + h[j : j + n])
    words = np.diff(first)
    counts = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    at = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(at[-1], dtype=np.uint64)
    few = np.flatnonzero((words > 0) & (words < size))
    x = words[few].astype(np.uint64)
    for j in range(size - 1):
        on = words[few] > j
        x[on] = mix64(x[on] * _U(0xD1342543DE82EF95) + h[first[few[on]] + j])
    if n:
        out[:] = mixed[np.minimum(_places(first[:-1], counts), n - 1)]
    out[at[few]] = x
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        out[a:b].sort()
    fresh = np.ones(len(out), dtype=bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[at[:-1][counts > 0]] = True
    return out[fresh], np.concatenate([[0], np.cumsum(fresh)])[at]


def _places(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin, begin + 1... for each of so many places, one run after another."""
    return np.arange(counts.sum()) + np.repeat(begin - np.cumsum(counts) + counts, counts)


def _run_sums(x: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of the runs of x that end there."""
    sums = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x, dtype=np.uint64, out=sums[1:])
    return sums[ends] - sums[ends - counts]


@dataclass(frozen=True)
class Plan:
    """How the domain is cut: first-level parts, second-level parts in each, and differing elements
    that one first-level part may hold; more than ``spare`` first-level parts hold no more."""

    first: int
    second: int
    errors: int
    spare: int

    @property
    def count(self) -> int:
        return self.first * comb(self.second, self.errors)

    @property
    def share(self) -> float:
        """Of the domain, in one signature."""
        return (self.second - self.errors) / (self.first * self.second)

    @property
    def subsets(self) -> np.ndarray:
        """0/1 rows: the second-level parts of each subset."""
        return np.array([[i in c for i in range(self.second)] for c in combinations(range(self.second), self.second - self.errors)], dtype=np.uint64)


@lru_cache(maxsize=4096)
def plan(k: int, low: int) -> Plan:
    """The plan with the fewest signatures that cover enough of a set of ``low`` elements, for k differing ones."""
    found = []
    for errors in range(min(k, 3) + 1):
        least = k // (errors + 1) + 1
        spare = 1 + least // 16 if least > 1 else 0
        for second in range(errors + 1, errors + 4):
            found.append(Plan(least + spare, second, errors, spare))
    enough = [p for p in found if p.share * low >= COVER]
    return min(enough, key=lambda p: (p.count, -p.share)) if enough else max(found, key=lambda p: (p.share, -p.count))


class Bands:
    """Size bands for the similarity num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low, self.high = [1], []

    def _grow(self, size: int) -> None:
        while self.low[-1] <= size * self.den // self.num + 1:
            low = self.low[-1]
            self.high.append(max(low, low * self.den * self.den // (self.num * self.num)))
            self.low.append(self.high[-1] + 1)

    def of(self, size: int) -> list[int]:
        """The bands a set of this size signs for: its own, and those of larger sets it may be similar to."""
        self._grow(size)
        own = int(np.searchsorted(self.low, size, side="right")) - 1
        out = [own]
        while self.low[out[-1] + 1] * self.num <= size * self.den:
            out.append(out[-1] + 1)
            self._grow(self.low[out[-1]])
        return out

    def differing(self, band: int) -> int:
        """The most elements in which a similar pair differs whose larger set is in this band."""
        return 2 * self.high[band] * (self.den - self.num) // (self.den + self.num)

    def agreeing(self, band: int, size: int) -> int:
        """The first-level parts at least in which a set of this size agrees with a similar one, the larger of them in this band."""
        p, largest = self.plan(band), min(self.high[band], size * self.den // self.num)
        return p.first - (size + largest) * (self.den - self.num) // (self.den + self.num) // (p.errors + 1)

    def plan(self, band: int) -> Plan | None:
        """None where only equal sets are similar enough (those are one node)."""
        k = self.differing(band)
        return plan(k, max(1, self.low[band] * self.num // self.den)) if k else None


def set_signatures(elements: np.ndarray, at: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """64-bit signatures of many sets, and for each signature the number of its set."""
    n = np.diff(at)
    sizes, kind = np.unique(n, return_inverse=True)
    members: dict[int, list[int]] = {}
    for i, size in enumerate(sizes.tolist()):
        for band in bands.of(size) if size else ():
            members.setdefault(band, []).append(i)
    mixed = mix64(elements ^ _U(0xA0761D6478BD642F))
    out, owners = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for band, mine in members.items():
        p = bands.plan(band)
        if p is None:
            continue
        agreeing = np.zeros(len(sizes), dtype=np.int64)
        agreeing[mine] = [bands.agreeing(band, s) for s in sizes[mine].tolist()]
        sets, parts, subsets = np.flatnonzero(agreeing[kind]), p.first * p.second, p.subsets
        place = mix64(np.arange(p.count, dtype=np.uint64).reshape(p.first, -1) + _U(band << 40))
        step = max(1, CELLS // p.count)
        for some in (sets[i : i + step] for i in range(0, len(sets), step)):
            own = _places(at[some], n[some])
            cell = ((elements[own] >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64) + np.repeat(np.arange(len(some)) * parts, n[some])
            counts = np.bincount(cell, minlength=len(some) * parts)
            content = _run_sums(mixed[own], np.cumsum(counts), counts).reshape(-1, p.first, p.second) @ subsets.T
            filled = counts.astype(np.uint64).reshape(-1, p.first, p.second) @ subsets.T
            least = np.sort(filled.min(axis=2), axis=1)[np.arange(len(some)), agreeing[kind[some]] - 1]
            strong = filled >= least[:, None, None]
            out.append(mix64(content + place)[strong])
            owners.append(np.repeat(some, strong.sum(axis=(1, 2))))
    return np.concatenate(out), np.concatenate(owners)


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    """64-bit signatures of a set."""
    return set_signatures(s, np.array([0, len(s)]), bands)[0]


def _class_hashes(elements: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    return tuple(_run_sums(mix64(elements ^ _U(salt)), at[1:], np.diff(at)) for salt in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


def _parities(elements: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Of each set, PARITIES words and the bytes of as many more as it is large.  Bit i: whether an odd
    number of elements has i as its place."""
    n = np.diff(at)
    words = np.array([max(MORE_PARITIES, 1 << (size // 64).bit_length()) for size in n.tolist()], dtype=np.int64)
    few, more = np.zeros((len(n), PARITIES), dtype=np.uint64), [b""] * len(n)
    for w in np.unique(words).tolist():
        sets, step = np.flatnonzero(words == w), max(1, CELLS // (64 * w))
        for some in (sets[i : i + step] for i in range(0, len(sets), step)):
            place = (elements[_places(at[some], n[some])] & _U(64 * w - 1)).astype(np.int64) + np.repeat(np.arange(len(some)) * (64 * w), n[some])
            odd = np.packbits((np.bincount(place, minlength=len(some) * 64 * w) & 1).astype(np.uint8)).reshape(len(some), -1)
            few[some] = np.bitwise_xor.reduce(odd.view(np.uint64).reshape(len(some), -1, PARITIES), axis=1)
            for i, x in zip(some.tolist(), odd):
                more[i] = x.tobytes()
    return few, more


def _describe(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, c1, c2, p0..., odd) of each document; c1 and c2 are two hashes of the whole set, p0... and odd its parities."""
    names = [f"p{i}" for i in range(PARITIES)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in text_slices(batch.column(1)):
                elements, at = shingle_sets(data, bounds, size)
                few, more = _parities(elements, at)
                cols = [batch.column(0).slice(a, b - a), pa.array(np.diff(at)), *(pa.array(x.view(np.int64)) for x in _class_hashes(elements, at))]
                cols += [*(pa.array(x) for x in few.view(np.int64).T), pa.array(more, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "c1", "c2", *names, "odd"])

    return docs.mapInArrow(tidy(work), "doc_id long, n long, c1 long, c2 long, " + ", ".join(f"{p} long" for p in names) + ", odd binary")


def _sign(docs: DataFrame, size: int, num: int, den: int, turn: int = 0, passes: int = 1) -> DataFrame:
    """(sig, c1): one share of the signatures of each document that has an id, with the first hash of its set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in batches:
            for _, _, data, bounds in text_slices(batch.column(0)):
                elements, at = shingle_sets(data, bounds, size)
                sigs, owners = set_signatures(elements, at, bands)
                mine = sigs % _U(passes) == turn
                c1 = _class_hashes(elements, at)[0][owners[mine]]
                yield pa.RecordBatch.from_arrays([pa.array(sigs[mine].view(np.int64)), pa.array(c1.view(np.int64))], ["sig", "c1"])

    return docs.where("doc_id is not null").select("text").mapInArrow(tidy(work), "sig long, c1 long")


def _named(ids: DataFrame) -> DataFrame:
    """Few ids go to all tasks; more are the built side of a shuffled join."""
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids.hint("shuffle_hash")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc_id, own): the whole sets, as bytes, of the documents in ``ids`` (doc_id)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in text_slices(batch.column(1)):
                elements, at = shingle_sets(data, bounds, size)
                own = [elements[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(own, pa.binary())], ["doc_id", "own"])

    return docs.join(_named(ids), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(tidy(work), "doc_id long, own binary")


def _folded(column: pa.Array, words: int) -> np.ndarray:
    """Parities (as bytes, of one length) as so many 64-bit words a row: places that fall together are added up."""
    x = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1, words)
    return np.bitwise_xor.reduce(x, axis=1)


def _near(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose parities don't differ in more bits than similar sets do in elements."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(c).to_numpy().astype(np.int64) for c in (2, 3))
                least = -(-(n + m) * num // (num + den))
                differing = np.zeros(batch.num_rows, dtype=np.int64)
                words = [np.array([len(x) // 8 for x in batch.column(c).to_pylist()]) for c in (4, 5)]
                #: Rows whose parities have the same lengths go together.
                lengths, which = np.unique(np.stack(words, axis=1), axis=0, return_inverse=True)
                for i, length in enumerate(lengths.tolist()):
                    at = np.flatnonzero(which == i)
                    x, y = (_folded(batch.column(c).take(pa.array(at)), min(length)) for c in (4, 5))
                    differing[at] = np.bitwise_count(x ^ y).sum(axis=1)
                near = differing <= n + m - 2 * least
                yield batch.select([0, 1]).filter(pa.array(near))

    #: Ids that stand for several sets (rows that share an id) are compared by each of them.
    own = classes.select(F.col("rep").alias("a"), "n", "odd")
    other = classes.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("odd").alias("even"))
    return pairs.join(own, "a").join(other, "b").select("a", "b", "n", "m", "odd", "even").mapInArrow(tidy(work), "a long, b long").distinct()


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with den * intersection >= num * union."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=np.uint64) for c in (2, 3))
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0
                keep[i] = both > 0 and den * both >= num * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    with_a = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("own").alias("set_a")), "a")
    with_b = with_a.join(sets.select(F.col("doc_id").alias("b"), F.col("own").alias("set_b")), "b")
    return with_b.select("a", "b", "set_a", "set_b").mapInArrow(tidy(work), "a long, b long")


def link(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    A text without words (or null) has an empty set and is linked with nothing; texts of any
    length are taken whole.  Rows that share an id are one node; a row without an id takes no part
    and has no component.  Repeated rows each get their row.  Other columns, whatever their
    names, are left out.  An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "partenum")
    docs = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("text"))
    odd = [f"p{i}" for i in range(PARITIES)]
    described = scratch.keep(scratch.write(_describe(docs, size), "described"))
    known = described.where("n > 0 and doc_id is not null")
    classes = scratch.keep(scratch.write(known.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ["n", *odd, "odd"]]), "classes"))
    parts = []
    for turn in range(PASSES):
        each = _sign(docs, size, num, den, turn, PASSES)
        #: Summed up before the shuffle, so the copies of one set are one row from each task.
        shared = each.groupBy("sig").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi")).where("lo <> hi").select("sig")
        shared = scratch.write(shared, "shared")
        parts.append(scratch.write(each.join(shared.hint("shuffle_hash"), "sig", "left_semi").distinct(), "members"))
        scratch.drop(shared)
    rows = reduce(DataFrame.union, parts).join(classes.select("c1", "rep", "n", *odd), "c1")
    rows = scratch.write(rows.select("sig", "rep", "n", *odd).distinct(), "candidates")
    scratch.drop(*parts)
    differing = " + ".join(f"bit_count({c} ^ q{i})" for i, c in enumerate(odd))
    close = F.expr(f"least(n, m) * {den} >= greatest(n, m) * {num} and {differing} <= n + m - 2 * (((n + m) * {num} + {num + den - 1}) div {num + den})")
    others = [F.col(c).alias(f"q{i}") for i, c in enumerate(odd)]

    #: Rows that share an id but not their set are one node.
    own = known.join(classes.select("c1", "c2", "rep"), ["c1", "c2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    split = classes.groupBy("rep").count().where("count > 1").select(F.col("rep").alias("a"))
    multiple = known.groupBy("doc_id").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi")).where("lo <> hi").select(F.col("doc_id").alias("a"))
    links = scratch.write(own.join(multiple.union(split).distinct(), "a", "left_semi"), "same-id")
    tested = None
    names = rows.withColumn("component", F.col("rep"))
    for turn in range(ROUNDS + 1):
        if turn:
            found = components(links)
            names = rows.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
            names = names.withColumn("component", F.coalesce("component", "rep"))
        #: Groups of one component are done with.
        counts = names.groupBy("sig", "component").count().groupBy("sig").agg(F.sum("count").alias("m"), F.sum(F.col("count") * F.col("count")).alias("own")).where("m * m > own")
        counts = scratch.write(counts, "open-groups")
        cost = counts.agg(F.sum(F.expr("(m * m - own) / 2")).alias("pairs"), F.sum("m").alias("rows")).first()
        if not cost["rows"]:
            break
        still = scratch.write(names.join(counts.select("sig"), "sig", "left_semi"), "open-rows")
        last = turn >= ROUNDS or turn > 0 and cost["pairs"] <= PAIRS_A_ROW * cost["rows"]
        if last:
            other = still.select("sig", F.col("rep").alias("other"), F.col("n").alias("m"), F.col("component").alias("there"), *others)
            pairs = still.join(other, "sig").where(close & F.expr("rep < other and component <> there"))
        else:  # the first round takes the smallest id, later ones another order each
            order = F.struct(F.lit(0) if not turn else F.xxhash64("rep", F.lit(turn)), F.col("rep").alias("other"), F.col("n").alias("m"), F.col("component").alias("there"), *others)
            anchor = still.groupBy("sig").agg(F.min(order).alias("x")).select("sig", "x.other", "x.m", "x.there", *[f"x.q{i}" for i in range(PARITIES)])
            pairs = still.join(anchor, "sig").where(close & F.expr("rep <> other and component <> there"))
        pairs = pairs.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.write(pairs, "pairs")
        near = scratch.write(_near(pairs, classes, num, den), "near")
        scratch.drop(counts, still)
        ids = scratch.write(near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct(), "ids")
        sets = scratch.write(_sets(docs, ids, size), "sets")
        links = links.union(scratch.write(_verify(near, sets, num, den), "verified"))
        scratch.drop(ids, sets)
        tested = pairs if tested is None else tested.union(pairs)
        if last:
            break
    found = components(links).select(F.col("node").alias("rep"), "component")
    linked = not links.isEmpty()
    scratch.drop()
    out = described.select("doc_id", "n", "c1", "c2").join(classes.select("c1", "c2", "rep"), ["c1", "c2"], "left")
    out = out.withColumn("rep", F.when(F.expr("n > 0 and doc_id is not null"), F.col("rep"))).join(found, "rep", "left")
    named = found.select(F.col("rep").alias("doc_id"), F.col("component").alias("named"))
    out = out.join(named, "doc_id", "left") if linked else out.withColumn("named", F.lit(None).cast("long"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("named", "component", "rep", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` but for those whose component has a smaller id: one document of each group stays.

    Rows without an id or without words stay; rows that repeat the smallest id all stay.
    """
    grouped = materialize(link(docs, **options).where("component_id < doc_id").select(F.col("doc_id").alias("gone_id")).distinct(), "grouped")
    key = options.get("doc_id", "doc_id")
    return docs.join(grouped, docs[quoted(key)] == grouped["gone_id"], "left_anti").select(*[quoted(c) for c in docs.columns])
