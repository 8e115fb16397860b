"""Bigram language-model scores from a log-frequency Bloom filter.

Counting: every task hashes its partition's n-grams and counts them, and sends one sorted run
a bucket; a bucket's runs are added up in one task (an n-gram is one entry of each run, so a
frequent one is no hot key).  The number of buckets follows the input.

Model: a count c is kept as its level q = 1 + floor(log2 c); a bucket's Bloom filter gets
(n-gram, 1) ... (n-gram, q), ``HASHES`` bits each.  A level is read by probing upwards until
the first miss, so an error can only raise it.  A token's probability interpolates the
bigram's relative frequency with the unigram's smoothed one.

The filter and the exact unigram counts go to the workers in blocks of at most ``BLOCK`` bytes.
A pass over the documents has two of them: a token is scored in the one pass that has its
context's block and its own, so passes add up, and nothing is cut off at any size.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquilt.llm.common import LOWER, WHITE, materialize, mix64, release, text_slices, word_hashes

_U = np.uint64
HASHES, BITS_AN_ENTRY, WEIGHT, BLOCK = 4, 8, 0.6, 192 << 20
#: Hashes of the end token, and of the context at a text's start.
END, START = _U(0x243F6A8885A308D3), _U(0x13198A2E03707344)
#: Entries a bucket should have, at most about this many.
BUCKET = 1_000_000


def _held_out(ids: pa.Array) -> np.ndarray:
    """crc32 of the id as text is 0 modulo 10; a null id reads as the empty text."""
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i in ids.to_pylist()], dtype=bool)


def _tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text, and the texts' offsets among them."""
    h, first = word_hashes(LOWER[data], bounds, WHITE)
    return np.insert(h, first[1:], END), first + np.arange(len(first))


def _bigrams(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context hash, bigram hash) of every token."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[at[:-1]] = START
    return before, mix64(before * _U(0x9E3779B97F4A7C15) + h)


def _count(x: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often (or with what sum of ``c``) each occurs."""
    if not len(x):
        return x, np.zeros(0, dtype=np.int64)
    if c is None:
        x = np.sort(x)
    else:
        order = np.argsort(x, kind="stable")
        x, c = x[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[at], np.diff(np.append(at, len(x))) if c is None else np.add.reduceat(c, at)


def _pack(x: np.ndarray, c: np.ndarray, wide: bool) -> tuple[bytes, bytes]:
    """Values with count 1 and the others apart, so that most counts need no room.

    A run's counts fit 32 bits, for a task counts a few million tokens at a time; sums have 64.
    """
    one = c == 1
    x = x if wide else (x & _U(0xFFFFFFFF)).astype(np.uint32)
    return x[one].tobytes(), x[~one].tobytes() + c[~one].astype(np.uint32).tobytes()


def _unpack(ones: bytes, more: bytes, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    kind = np.uint64 if wide else np.uint32
    x, n = np.frombuffer(ones, dtype=kind), len(more) // (np.dtype(kind).itemsize + 4)
    y = np.frombuffer(more, dtype=kind, count=n)
    c = np.frombuffer(more, dtype=np.uint32, offset=n * y.itemsize)
    return np.concatenate([x, y]), np.concatenate([np.ones(len(x), dtype=np.int64), c.astype(np.int64)])


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """0 .. buckets - 1, from the upper half of the hash."""
    return ((h >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _runs(docs: DataFrame, buckets: int) -> DataFrame:
    """(kind, bucket, ones, more): each task's counted n-grams.  kind 1: unigrams under their own
    hash; kind 2: bigrams in their context's bucket, under 32 bits that the bucket extends."""

    def flush(uni: list, bi: list) -> Iterator[pa.RecordBatch]:
        rows = []
        x, c = _count(np.concatenate(uni))
        cuts = np.searchsorted(_bucket(x, buckets), np.arange(buckets + 1))
        rows += [(1, b, *_pack(x[i:j], c[i:j], True)) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
        context, pair = np.concatenate([p[0] for p in bi]), np.concatenate([p[1] for p in bi])
        x, c = _count((_bucket(context, buckets).astype(np.uint64) << _U(32)) | (pair & _U(0xFFFFFFFF)))
        cuts = np.searchsorted(x >> _U(32), np.arange(buckets + 1, dtype=np.uint64))
        rows += [(2, b, *_pack(x[i:j], c[i:j], False)) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
        cols = list(zip(*rows))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        for i in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 256], k) for c, k in zip(cols, kinds)], ["kind", "bucket", "ones", "more"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni, bi, size = [], [], 0
        for batch in batches:
            train = ~_held_out(batch.column(0))
            batch = batch.filter(pa.array(train))
            for _, _, data, bounds in text_slices(batch.column(1)):
                h, at = _tokens(data, bounds)
                before, pair = _bigrams(h, at)
                uni.append(h)
                bi.append((before, pair))
                size += len(h)
                if size > 4_000_000:
                    yield from flush(uni, bi)
                    uni, bi, size = [], [], 0
        if size:
            yield from flush(uni, bi)

    return docs.mapInArrow(work, "kind int, bucket int, ones binary, more binary")


def _levels(c: np.ndarray) -> np.ndarray:
    return np.frexp(c.astype(np.float64))[1].astype(np.int64)


def _probe(pair: np.ndarray, level: int, j: int) -> np.ndarray:
    """32 bits from the n-gram's 32, its level and the hash function's number."""
    return mix64((pair & _U(0xFFFFFFFF)) + _U((level * HASHES + j + 1) << 32)) >> _U(32)


def _blocks(runs: DataFrame, buckets: int) -> DataFrame:
    """(kind, bucket, n, keys, counts, bits): a bucket's exact unigrams, or its filter as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                kind, b, ones, more = (batch.column(k)[i].as_py() for k in range(4))
                held.setdefault((kind, b), []).append(_unpack(ones, more, kind == 1))
        for (kind, b), got in held.items():
            x, c = _count(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
            if kind == 1:
                row = (1, b, len(x), x.tobytes(), c.astype(np.int64).tobytes(), b"")
            else:
                q = _levels(c)
                size = max(64, -(-int(q.sum()) * BITS_AN_ENTRY // 64) * 64)
                bits = np.zeros(size, dtype=bool)
                for level in range(1, int(q.max()) + 1):
                    own = x[q >= level].astype(np.uint64)
                    for j in range(HASHES):
                        bits[(_probe(own, level, j) * _U(size) >> _U(32)).astype(np.int64)] = True
                row = (2, b, len(x), b"", b"", np.packbits(bits, bitorder="little").tobytes())
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["kind", "bucket", "n", "keys", "counts", "bits"])

    return runs.repartition(buckets, "kind", "bucket").mapInArrow(work, "kind int, bucket int, n long, keys binary, counts binary, bits binary")


class Filter:
    """A run of buckets of the filter."""

    def __init__(self, low: int, sizes: np.ndarray, words: np.ndarray):
        #: First bucket, bits of each bucket, and all their bytes; ``at`` is where a bucket begins.
        self.low, self.sizes, self.words = low, sizes, words
        self.at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def level(self, pair: np.ndarray, bucket: np.ndarray, most: int = 40) -> np.ndarray:
        """Stored level of each n-gram, 0 for what was never seen; too high where probes hit by chance."""
        out, left = np.zeros(len(pair), dtype=np.int64), np.arange(len(pair))
        at, size = self.at[bucket - self.low], self.sizes[bucket - self.low].astype(np.uint64)
        for level in range(1, most):
            for j in range(HASHES):
                p = at[left] + (_probe(pair[left], level, j) * size[left] >> _U(32)).astype(np.int64)
                left = left[(self.words[p >> 3] >> (p & 7).astype(np.uint8)) & 1 != 0]
            if not len(left):
                break
            out[left] = level
        return out


def _middle(level: np.ndarray) -> np.ndarray:
    """A count that stands for its level: the geometric middle of 2^(q-1) .. 2^q."""
    return np.where(level == 1, 1.0, np.where(level > 0, np.exp2(level - 0.585), 0.0))


class Block:
    """What a run of buckets holds: sorted unigram hashes with their counts, and their filter."""

    def __init__(self, low: int, high: int, rows: list):
        uni = {r["bucket"]: r for r in rows if r["kind"] == 1}
        bits = {r["bucket"]: r["bits"] for r in rows if r["kind"] == 2}
        self.low, self.high = low, high
        own = [uni[b] for b in sorted(uni)]
        self.keys = np.frombuffer(b"".join([r["keys"] for r in own]), dtype=np.uint64)
        self.counts = np.frombuffer(b"".join([r["counts"] for r in own]), dtype=np.int64)
        empty = b"\0" * 8
        parts = [bits.get(b, empty) for b in range(low, high)]
        self.filter = Filter(low, np.array([8 * len(x) for x in parts]), np.frombuffer(b"".join(parts), dtype=np.uint8))

    def has(self, bucket: np.ndarray) -> np.ndarray:
        return (bucket >= self.low) & (bucket < self.high)

    def count(self, h: np.ndarray) -> np.ndarray:
        """Exact unigram counts."""
        if not len(self.keys):
            return np.zeros(len(h), dtype=np.int64)
        x, back = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
        return np.where(self.keys[at] == x, self.counts[at], 0).astype(np.int64)[back]


def _gather(blocks: DataFrame, buckets: int, most: int) -> Iterator[Block]:
    """The buckets in order, in blocks of at most ``most`` bytes (one bucket at least)."""
    low, at, part, size = 0, 0, [], 0
    for row in blocks.orderBy("bucket", "kind").toLocalIterator():
        own = len(row["keys"]) + len(row["counts"]) + len(row["bits"])
        if part and row["bucket"] != at and size + own > most:
            yield Block(low, row["bucket"], part)
            low, part, size = row["bucket"], [], 0
        at = row["bucket"]
        part.append(row)
        size += own
    yield Block(low, buckets, part)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = BLOCK) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    The model learns from the rows whose crc32(id as text) modulo 10 is not 0; a null id reads
    as an empty text.  A null text is empty and has the end token alone.  Repeated rows count as
    often as they stand there.  Where no row is left to learn from, no token is known and every
    one has the same score; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0
    size, texts = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.when(train, 1))).first()
    buckets = max(16, math.ceil(size / 6 / BUCKET))
    blocks = materialize(_blocks(_runs(docs, buckets), buckets), "counts")
    release(spark)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(np.frombuffer(c.as_py(), dtype=np.int64).sum()) for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64())], ["n", "tokens"])

    facts = blocks.where("kind = 1").select("n", "counts").mapInArrow(total, "n long, tokens long").agg(F.sum("n"), F.sum("tokens")).first()
    v, n = int(facts[0] or 0), int(facts[1] or 0)
    shared = [spark.sparkContext.broadcast(b) for b in _gather(blocks, buckets, most)]
    names = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    if len(shared) == 1:
        return _pass(docs, shared[0], shared[0], buckets, v, n, texts).select("doc_id", *names)
    parts = [materialize(_pass(docs, x, y, buckets, v, n, texts).withColumn("pass", F.lit(k)), "scores") for k, (x, y) in enumerate(itertools.product(shared, shared))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    #: Equal rows have equal sums; they are taken together in each pass and dealt out again.
    sums = ["n_known", "base_score", "score"]
    once = rows.groupBy("doc_id", "h", "held_out", "n_tokens", "train_tokens", "pass").agg(F.count(F.lit(1)).alias("k"), *[F.max(c).alias(c) for c in sums])
    out = once.groupBy("doc_id", "h", "held_out", "n_tokens", "train_tokens").agg(F.max("k").alias("k"), *[F.sum(c).alias(c) for c in sums])
    return out.withColumn("k", F.explode(F.sequence(F.lit(1), "k"))).select("doc_id", *names)


def _pass(docs: DataFrame, contexts, words, buckets: int, v: int, n: int, texts: int) -> DataFrame:
    """The sums of the tokens whose context is in one block and whose word is in the other."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c_block, w_block = contexts.value, words.value
        below = n + 0.1 * (v + 1)
        for batch in batches:
            held = _held_out(batch.column(0))
            for a, b, data, bounds in text_slices(batch.column(1)):
                h, at = _tokens(data, bounds)
                before, pair = _bigrams(h, at)
                bucket = _bucket(before, buckets)
                mine = np.flatnonzero(c_block.has(bucket) & w_block.has(_bucket(h, buckets)))
                count = w_block.count(h[mine])
                unigram = (count + 0.1) / below
                context = c_block.count(before[mine]).astype(np.float64)
                context[before[mine] == START] = texts
                seen = _middle(c_block.filter.level(pair[mine], bucket[mine]))
                share = np.minimum(1.0, np.divide(seen, context, out=np.zeros_like(seen), where=context > 0))
                model = WEIGHT * share + (1 - WEIGHT) * unigram
                sums = []
                for values in (count > 0, np.log10(unigram), np.log10(model)):
                    all_ = np.zeros(len(h), dtype=np.float64)
                    all_[mine] = values
                    sums.append(np.add.reduceat(all_, at[:-1]))
                m = b - a
                cols = [batch.column(0).slice(a, m), batch.column(2).slice(a, m), pa.array(held[a:b]), pa.array(np.diff(at)), pa.array(sums[0].astype(np.int64))]
                cols += [pa.array(np.full(m, n, dtype=np.int64)), pa.array(sums[1]), pa.array(sums[2])]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(work, f"doc_id {kind}, h long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
