"""BPE encoding and decoding by a pair occurrence index over a partition's words.

Each task walks its partition in runs of texts.  The distinct words a run adds are encoded
together: an index maps every adjacent symbol pair to all its positions in these words, the
pairs' ranks are applied in ascending order to all their positions at once, and the positions
of pairs that appear or vanish beside a merge are added or skipped.  A text is then the
concatenation of its words' ids.  Words are kept between runs up to ``MEMO`` bytes.

Only a map over documents: no shuffle, so one hot source or group of copies costs nothing extra.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pixelquilt.llm.common import add_columns

#: Texts taken together, in characters, and what words remembered take, in bytes: bounds on a worker's memory.
RUN, MEMO = 2 << 20, 32 << 20
#: Bytes of a remembered word besides its own and its tokens'.
WORD_COSTS = 240
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_ASCII_WORDS = re.compile(r"[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9]+")
#: White space to Python's own patterns and not to the vocabulary's: such texts take the general pattern.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_SPACES = regex.compile(r"\s+")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte, as byte-level vocabularies spell it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b], extra = chr(256 + extra), extra + 1
    return out


class PairIndexBpe:
    """Encoder and decoder for a byte-level BPE vocabulary with a word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = byte_letters()
        self.inner = np.array([self.vocab[letters[b]] for b in range(256)], dtype=np.int64)
        self.final = np.array([self.vocab[letters[b] + self.suffix] for b in range(256)], dtype=np.int64)
        left, right, made = [], [], []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left.append(self.vocab[a])
            right.append(self.vocab[b])
            made.append(self.vocab[a + b])
        self.left, self.right, self.made = (np.array(x, dtype=np.int64) for x in (left, right, made))
        keys = self.left * (1 << 32) + self.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.known: dict[str, tuple[bytes, str]] = {}
        self.held = 0

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it is no merge."""
        key = a * (1 << 32) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each distinct word."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum(size)
        sym = self.inner[data]
        sym[ends - 1] = self.final[data[ends - 1]]
        n = len(sym)
        #: The next and the previous live symbol of the same word; n and -1 beyond its ends.
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = n
        before[ends - size] = -1
        held: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> int:
            """Index the pairs that start at these positions; the lowest rank among them."""
            at = at[after[at] < n]
            if not len(at):
                return len(self.made)
            r = self._rank(sym[at], sym[after[at]])
            at, r = at[r >= 0], r[r >= 0]
            if not len(at):
                return len(self.made)
            if len(at) > 1:
                order = np.argsort(r, kind="stable")
                at, r = at[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            edges = [0, *cuts.tolist(), len(r)]
            for i, j in zip(edges, edges[1:]):
                rank = int(r[i])
                if rank in held:
                    held[rank].append(at[i:j])
                else:
                    held[rank] = [at[i:j]]
                    heapq.heappush(active, rank)
            return int(r[0])

        add(np.arange(n))
        while active:
            rank = heapq.heappop(active)
            lists = held.pop(rank)
            a, b, c = self.left[rank], self.right[rank], self.made[rank]
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            nxt = after[at]
            live = (sym[at] == a) & (nxt < n)
            live[live] = sym[nxt[live]] == b
            at = at[live]
            if not len(at):
                continue
            if a == b and len(at) > 1:  # of overlapping occurrences the left one counts
                at, keep, last = np.sort(at), [], -1
                for p in at.tolist():
                    if p != last:
                        keep.append(p)
                        last = int(after[p])
                at = np.array(keep, dtype=np.int64)
            gone = after[at]
            sym[at], sym[gone] = c, -1
            after[at] = after[gone]
            more = after[at] < n
            before[after[at][more]] = at[more]
            prev = before[at]
            add(np.unique(np.concatenate([prev[prev >= 0], at[more]])))
        live = sym >= 0
        count = np.add.reduceat(live, ends - size) if n else np.zeros(0, np.int64)
        return np.split(sym[live], np.cumsum(count)[:-1]) if len(words) else []

    def normal(self, text: str) -> str:
        """Canonical composition, one blank for white space, lower case letter by letter."""
        if text.isascii():
            return text.lower()
        text = _SPACES.sub(" ", unicodedata.normalize("NFC", text))
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def words(self, text: str) -> list[str]:
        text = self.normal(text)
        return (_ASCII_WORDS if text.isascii() and not _SEPARATORS.search(text) else _WORDS).findall(text)

    def pieces(self, text: str) -> list[str]:
        """Words, and special tokens as they are."""
        if self.split is None or not any(s in text for s in self.special):
            return self.words(text)
        out: list[str] = []
        for i, part in enumerate(self.split.split(text)):
            out += [part] if i % 2 else self.words(part)
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Encode those of the words that aren't remembered."""
        known = self.known
        fresh = [w for w in words if w not in known]
        plain = [w for w in fresh if w not in self.special]
        for w in fresh:
            if w in self.special:
                known[w] = (np.array([self.special[w]], dtype="<u4").tobytes(), w)
        names = self.names
        for w, ids in zip(plain, self.encode_words(plain)):
            got = known[w] = (ids.astype("<u4").tobytes(), " ".join([names[i] for i in ids.tolist()]))
            self.held += WORD_COSTS + len(w) + len(got[0]) + len(got[1])

    def encode_run(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        each = [self.pieces(t) for t in texts]
        new = set().union(*each) if each else set()
        if self.held > MEMO:
            self.known.clear()
            self.held = 0
        self.learn(new)
        known, out = self.known, []
        for ws in each:
            got = [known[w] for w in ws]
            out.append((b"".join([g[0] for g in got]), " ".join([g[1] for g in got])))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join([self.names[int(i)] for i in ids if int(i) in self.names])


_loaded: dict[str, PairIndexBpe] = {}


def coder(path: str) -> PairIndexBpe:
    if path not in _loaded:
        _loaded[path] = PairIndexBpe(path)
    return _loaded[path]


def runs(column: pa.Array, most: int = RUN) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``most`` characters; null reads as empty."""
    got, size = [], 0
    for i in range(len(column)):
        t = column[i].as_py() or ""
        got.append(t)
        size += len(t)
        if size >= most:
            yield got
            got, size = [], 0
    if got:
        yield got


def encode(docs: DataFrame, path: str, text: str = "text", ids: str | None = "token_ids", decoded: str | None = None, digests: bool = False) -> DataFrame:
    """Each row with its token ids, and where named its decoded text or the digests of both.

    Null and empty texts have no tokens; repeated rows, null ids and further columns of any name
    pass through; a result column that exists already is replaced.  An empty table gives an empty
    one.  Texts of any length are taken whole.
    """
    fields = [("n_tokens", "bigint")] + [(ids, "array<int>")] * bool(ids) + [(decoded, "string")] * bool(decoded)
    fields += [("ids_sha256", "string"), ("decoded_sha256", "string")] * digests

    def work(column: pa.Array) -> Iterator[list[pa.Array]]:
        bpe = coder(path)
        for texts in runs(column):
            got = bpe.encode_run(texts)
            sizes = np.array([len(g[0]) // 4 for g in got], dtype=np.int64)
            out: list[pa.Array] = [pa.array(sizes)]
            if ids:
                flat = np.frombuffer(b"".join([g[0] for g in got]), dtype="<i4")
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat)))
            if decoded:
                out.append(pa.array([g[1] for g in got], pa.string()))
            if digests:
                out.append(pa.array([hashlib.sha256(g[0]).hexdigest() for g in got]))
                out.append(pa.array([hashlib.sha256(g[1].encode()).hexdigest() for g in got]))
            yield out

    return add_columns(docs, text, fields, work)
