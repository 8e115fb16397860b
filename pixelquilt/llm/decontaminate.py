"""Benchmark decontamination by Wu-Manber search over words.

A window is ``WINDOW`` consecutive words of a benchmark item (all its words, if it has fewer).
The symbols of the search are words, its blocks are pairs of words.  Patterns are grouped by
length; each group has a shift table over blocks, which tells how far the search may jump
ahead, and buckets under the hash of a pattern's last block, whose patterns are compared with
the text word by word.

Only a map over documents.  The tables come from the benchmark alone: it is split into parts
of at most ``PART`` windows, and documents pass each part in turn, so what is sent to the
workers is bounded whatever the benchmark's size; hits travel along as spans.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from pixelquilt.llm.common import quoted

WINDOW, PART = 10, 500_000
_WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words in order, A-Z lower-cased: runs of 0-9, a-z and everything above ASCII."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


def windows(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if len(words) < size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


class WuManber:
    """Multi-pattern search for patterns of one length over sequences of words."""

    def __init__(self, patterns: list[tuple[bytes, ...]]):
        m = self.length = len(patterns[0])
        self.block = 2 if m >= 2 else 1
        self.most = m - self.block + 1
        #: How far the window may move when it ends in this block; ``most`` for all other blocks.
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[int, list[tuple[tuple[bytes, ...], int]]] = defaultdict(list)
        for k, p in enumerate(patterns):
            for j in range(self.block, m + 1):
                key = b" ".join(p[j - self.block : j])
                self.shift[key] = min(self.shift.get(key, self.most), m - j)
            self.bucket[hash(b" ".join(p[m - self.block :]))].append((p, k))
        #: Words that end some block: most text positions are decided by this look-up alone.
        self.ends = {key.rpartition(b" ")[2] for key in self.shift}

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(start, pattern number) of every occurrence."""
        m, most, shift, ends, n = self.length, self.most, self.shift, self.ends, len(words)
        two, i = self.block == 2, self.length - 1
        while i < n:
            w = words[i]
            if w not in ends:
                i += most
                continue
            key = words[i - 1] + b" " + w if two else w
            jump = shift.get(key, most)
            if jump:
                i += jump
                continue
            start = i - m + 1
            for p, k in self.bucket.get(hash(key), ()):
                if words[start] == p[0] and tuple(words[start : i + 1]) == p:
                    yield start, k
            i += 1


def covered(spans: list[tuple[int, int]]) -> int:
    """Positions inside any of the [start, end) spans."""
    total, reach = 0, -1
    for a, b in sorted(spans):
        if b > reach:
            total += b - max(a, reach)
            reach = b
    return total


def _parts(benchmark: DataFrame, item: str, text: str, size: int, most: int) -> Iterator[list[tuple[tuple[bytes, ...], list[str]]]]:
    """The benchmark's distinct windows with the items they occur in, in parts of ``most`` windows."""
    own: dict[tuple[bytes, ...], dict[str, None]] = defaultdict(dict)
    rows = benchmark.where(benchmark[quoted(item)].isNotNull()).select(benchmark[quoted(item)].cast("string"), quoted(text)).toLocalIterator()
    for i, t in rows:  # one partition at a time
        for w in windows(words_of(t), size):
            own[w][i] = None
        if len(own) >= most:
            yield [(w, list(items)) for w, items in own.items()]
            own.clear()
    if own:
        yield [(w, list(items)) for w, items in own.items()]


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, most: int = PART) -> DataFrame:
    """Each document with ``hit_spans`` ([start word, end word) of each occurrence), ``hit_items``,
    and ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` derived from them.

    Null and empty texts have no words; items without words or without id have no windows; an
    empty benchmark hits nothing.  Repeated rows and ids pass through, one row each.  Items that
    share a window all count.  Texts of any length are taken whole.  Result columns replace columns
    of the same name; further columns may have any name.
    """
    spark = docs.sparkSession
    own = ["hit_spans", "hit_items", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    docs = docs.drop(*own)
    callers = docs.columns
    #: Columns travel under names of our own.
    docs, text = docs.toDF(*[f"in_{i}" for i in range(len(callers))]), f"in_{callers.index(text)}"
    kept_columns = docs.columns
    base = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def scan(df: DataFrame, part, first: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(part)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_length = defaultdict(list)
            for w, items in shared.value:
                by_length[len(w)].append((w, items))
            searches = [(n, WuManber([w for w, _ in ps]), [i for _, i in ps]) for n, ps in by_length.items()]
            for batch in batches:
                names = batch.schema.names
                texts = batch.column(names.index(text))
                kept = None if first else (batch.column(names.index("hit_spans")), batch.column(names.index("hit_items")))
                out = []
                for k in range(len(texts)):
                    words = words_of(texts[k].as_py())
                    spans = [] if first else [(s["start"], s["end"]) for s in kept[0][k].as_py()]
                    items = set() if first else set(kept[1][k].as_py())
                    for n, search, names_of in searches:
                        for start, p in search.search(words):
                            spans.append((start, start + n))
                            items.update(names_of[p])
                    spans.sort()
                    ids = sorted(items)
                    hit = covered(spans)
                    out.append((spans, ids, len(words), hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0))
                cols = list(zip(*out)) if out else [[] for _ in own]
                arrays = [batch.column(names.index(c)) for c in kept_columns]
                arrays.append(pa.array([[{"start": a, "end": b} for a, b in s] for s in cols[0]], spans_type))
                kinds = [pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
                arrays += [pa.array(list(c), kind) for c, kind in zip(cols[1:], kinds)]
                yield pa.RecordBatch.from_arrays(arrays, [*kept_columns, *own])

        schema = f"{base}, hit_spans array<struct<start:int,end:int>>, hit_items array<string>, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
        return df.mapInArrow(work, schema)

    out, first = docs, True
    for part in _parts(benchmark, item, item_text, size, most):
        out, first = scan(out, part, first), False
    return (scan(out, [], True) if first else out).toDF(*callers, *own)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit, with their own columns."""
    found = find(docs, benchmark, **options)
    return found.where(~found.contaminated).select(*[quoted(c) for c in docs.columns])
