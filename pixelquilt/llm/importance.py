"""Target-distribution importance resampling over hashed word n-grams, by CRC combination algebra.

A feature's bucket is the CRC-32 of its UTF-8 bytes.  Each word's CRC is computed once, byte
position by byte position for all words of a chunk together.  The CRC of an n-gram follows from
those of its words: appending L bytes multiplies the CRC by a GF(2) matrix that depends on L
alone, a product of the matrices for the powers of two in L, so no n-gram is ever spelled out.

Tasks add up bucket counts before anything is shuffled: what travels is one row a bucket and
task, bounded by ``buckets``.  Ranks come from counts by score, then windows within one score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelquilt.llm.common import LOWER, Scratch, add_columns, quoted, release, text_slices

#: The CRC's reflected polynomial; a fixed value of the format.
POLYNOMIAL = 0xEDB88320
#: Words up to so many bytes are hashed together, longer ones by themselves.
SHORT = 48
#: Bytes of text handled at once: bounds the arrays; a word is never cut.
CHUNK = 1 << 20
#: Scores in one step of the coarse counts.
BAND = 512
_WORD = np.zeros(256, dtype=bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[128:] = True


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(POLYNOMIAL), c >> 1)
    return c


_TABLE = _byte_table()


def _times(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The GF(2) matrix with these 32 columns times each vector."""
    out = np.zeros_like(x)
    for bit in range(32):
        out ^= np.where(x >> np.uint32(bit) & 1, columns[bit], np.uint32(0))
    return out


def _shifts(most: int = 40) -> list[np.ndarray]:
    """For k = 0, 1, ...: the matrix that appends 2**k bytes, as four tables by byte of the vector."""
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    columns, out = _TABLE[unit & 255] ^ unit >> np.uint32(8), []
    for _ in range(most):
        out.append(np.stack([_times(columns, np.arange(256, dtype=np.uint32) << np.uint32(8 * b)) for b in range(4)]))
        columns = _times(columns, columns)
    return out


_SHIFTS = _shifts()


def shift(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each CRC multiplied by the matrix that appends ``size`` bytes."""
    out = crc.copy()
    for k in range(int(size.max(initial=0)).bit_length()):
        at = np.flatnonzero(size >> k & 1)
        x, t = out[at], _SHIFTS[k]
        out[at] = t[0][x & 255] ^ t[1][x >> np.uint32(8) & 255] ^ t[2][x >> np.uint32(16) & 255] ^ t[3][x >> np.uint32(24)]
    return out


def combine(a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """CRC of two strings one after another, of their CRCs and the second's size."""
    return shift(a, size_b) ^ b


def word_crcs(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of the words data[start : start + size]."""
    out = np.zeros(len(start), dtype=np.uint32)
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -SHORT))  # these are longer than SHORT
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[start[i] : start[i] + size[i]])
    order = order[long:]
    at, left = start[order], size[order]
    reg = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for j in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -j))  # words of more than j bytes stand first
        reg[:n] = _TABLE[(reg[:n] ^ data[at[:n] + j]) & 255] ^ reg[:n] >> np.uint32(8)
    out[order] = ~reg
    return out


def ngram_crcs(crc: np.ndarray, size: np.ndarray, text: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(CRCs, texts) of the runs of 1, 2, ... ``most`` words, joined by one blank, within a text."""
    run, of = crc, text
    yield run, of
    if most > 1:
        blank = np.uint32(zlib.crc32(b" "))
        after = combine(np.full(len(crc), blank), crc, size)  # of a blank and the word
        for n in range(1, most):
            if len(run) < 2:
                return
            run, of = run[:-1], of[:-1]
            inside = text[n:] == of
            run = np.where(inside, combine(run, after[n:], size[n:] + 1), 0).astype(np.uint32)
            yield run[inside], of[inside]


class _Texts:
    """Features of texts, chunk by chunk."""

    def __init__(self, most: int, buckets: int):
        self.most, self.buckets = most, buckets

    def features(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(buckets, texts, words of each text of this chunk); runs of words don't end with a chunk."""
        n, at = len(data), 0
        tail = (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))
        while at < n:
            end = min(n, at + CHUNK)
            while end < n and _WORD[LOWER[data[end]]]:
                stop = LOWER[data[end : end + CHUNK]]
                gap = np.flatnonzero(~_WORD[stop])
                end = end + int(gap[0]) if len(gap) else min(n, end + CHUNK)
            piece = LOWER[data[at:end]]
            mask = _WORD[piece]
            first, last = mask.copy(), mask.copy()
            first[1:] &= ~mask[:-1]
            last[:-1] &= ~mask[1:]
            cuts = bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, end)] - at
            first[cuts] |= mask[cuts]
            cuts = cuts[cuts > 0]
            last[cuts - 1] |= mask[cuts - 1]
            start = np.flatnonzero(first)
            size = np.flatnonzero(last) + 1 - start
            text = np.searchsorted(bounds, start + at, side="right") - 1
            crc = word_crcs(piece, start, size)
            words = np.bincount(text, minlength=len(bounds) - 1)
            old = len(tail[0])
            crc, size, text = (np.concatenate(x) for x in zip(tail, (crc, size, text)))
            got = [(c, t) for c, t in ngram_crcs(crc, size, text, self.most)]
            # runs that end within the tail were given with the chunk before
            new = [(c[t_keep], t[t_keep]) for (c, t), t_keep in zip(got, _ends_after(text, self.most, old))]
            yield np.concatenate([c for c, _ in new]) % np.uint32(self.buckets), np.concatenate([t for _, t in new]), words
            keep = self.most - 1
            tail = (crc[-keep:], size[-keep:], text[-keep:]) if keep else tail
            at = end

    def counts(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(self.buckets, dtype=np.int64)
        for _, _, data, bounds in text_slices(column):
            for bucket, _, _ in self.features(data, bounds):
                out += np.bincount(bucket, minlength=self.buckets)
        return out

    def sums(self, column: pa.Array, gain: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(words, features, sum of gains) of each text."""
        for a, b, data, bounds in text_slices(column):
            n_words, n, total = (np.zeros(b - a, dtype=np.int64) for _ in range(3))
            for bucket, text, words in self.features(data, bounds):
                n_words += words
                n += np.bincount(text, minlength=b - a)
                total += np.bincount(text, gain[bucket], minlength=b - a).astype(np.int64)
            yield n_words, n, total


def _ends_after(text: np.ndarray, most: int, old: int) -> Iterator[np.ndarray]:
    """Of the runs of 1, 2, ... words within a text: whether each ends at word ``old`` or later."""
    for n in range(most):
        if n and len(text) < n + 1:
            return
        at = np.arange(len(text) - n)
        yield at[text[n:] == text[: len(text) - n]] + n >= old if n else at >= old


def bucket_counts(docs: DataFrame, text: str, most: int, buckets: int) -> DataFrame:
    """(bucket, n) over all rows; tasks add up before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, total = _Texts(most, buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += texts.counts(batch.column(0))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    only = docs.select(docs[quoted(text)].alias("in_text"))
    return only.mapInArrow(work, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", most: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) of every bucket: 1000 times the smoothed log ratio of target to documents, floored."""
    s = bucket_counts(docs, text, most, buckets).withColumnRenamed("n", "s")
    t = bucket_counts(target, text, most, buckets).withColumnRenamed("n", "t")
    every = docs.sparkSession.range(buckets, numPartitions=1).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0, ["s", "t"])
    whole = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    up = (F.col("t") + 1).cast("double") * (F.col("all_s") + buckets).cast("double")
    down = (F.col("s") + 1).cast("double") * (F.col("all_t") + buckets).cast("double")
    return both.crossJoin(F.broadcast(whole)).select("bucket", F.floor(1000 * F.log(up / down)).cast("long").alias("gain"))


def _noise(doc_id: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; rank null where it isn't drawn.

    Null and empty texts have no features and weight 0; null ids are hashed as empty and lose
    ties; repeated rows have one score and take ranks one after another; ties go to the smaller
    id.  An empty table gives an empty one, an empty target counts of 0.  Texts of any length
    are taken whole.  Further columns, of any name, are left aside: see ``draw``.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "importance")
    slim = docs.select(docs[quoted(doc_id)].alias("doc_id"), docs[quoted(text)].alias("text"))
    # one number a bucket: bounded by the parameter, whatever the input
    gain = np.zeros(buckets, dtype=np.int64)
    for row in gains(slim, target.select(target[quoted(text)].alias("text")), "text", most, buckets).toLocalIterator():
        gain[row["bucket"]] = row["gain"]
    release(spark)

    def work(column: pa.Array) -> Iterator[list[pa.Array]]:
        for n_words, n, total in _Texts(most, buckets).sums(column, gain):
            yield [pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))]

    weighed = add_columns(slim, "text", [("n_words", "bigint"), ("n_features", "bigint"), ("weight", "bigint")], work)
    scored = scratch.keep(scratch.write(weighed.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + _noise(F.col("doc_id"), seed)).alias("score")), "scored"))
    return _ranked(scored, percent, least_words)


def _ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Ranks by score without a global sort.

    Counts by score are at most as many as scores (weights are bounded by logarithms of counts,
    the noise by its 32 bits: some 200,000 values), those by band of scores a few hundred.
    """
    fit = F.col("n_words") >= least_words
    by_score = scored.where(fit).groupBy("score").agg(F.count("*").alias("n")).withColumn("band", F.floor(F.col("score") / BAND))
    by_band = by_score.groupBy("band").agg(F.sum("n").alias("n"))
    upto = (Window.unboundedPreceding, -1)
    bands = by_band.select("band", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("band")).rowsBetween(*upto)), F.lit(0)).alias("over"), F.expr(f"(sum(n) over () * {int(percent)}) div 100").alias("drawn"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy("band").orderBy(F.desc("score")).rowsBetween(*upto)), F.lit(0))
    scores = by_score.withColumn("within", above).join(F.broadcast(bands), "band").select("score", (F.col("over") + F.col("within")).alias("above"), "drawn").where("above < drawn")
    marked = scored.join(F.broadcast(scores), "score", "left").withColumn("near", fit & F.col("above").isNotNull())
    # rows that can't be drawn are dealt by their own hash, the others meet by score
    deal = F.when(F.col("near"), F.lit(0)).otherwise(F.xxhash64("doc_id", "n_features"))
    place = F.col("above") + F.row_number().over(Window.partitionBy(F.when(F.col("near"), F.col("score")), deal).orderBy(F.col("doc_id").asc_nulls_last()))
    return marked.select("doc_id", "n_features", "weight", "score", F.when(F.col("near"), place).alias("rank"), "drawn").select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).cast("long").alias("rank"))


def draw(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of ``docs``, with all their columns; rows of one id stay or go together, null ids go."""
    drawn = resample(docs, target, doc_id, **options).where("rank is not null").select(F.col("doc_id").alias("importance_drawn_id")).distinct()
    return docs.join(drawn, docs[quoted(doc_id)] == F.col("importance_drawn_id"), "left_semi")
