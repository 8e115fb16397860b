"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A run of texts is one flat NumPy array of symbols.  Texts are cut between two characters that
stand side by side in no piece, as no merge can cross there; equal words of a run are encoded
once.  In every round each word's lowest pair rank is found (a segmented minimum), all its
occurrences that do not overlap an earlier one merge at once, the array is compacted, and only
pairs beside a merge are looked up again, until no word has a pair left.

Pieces that can grow at once into a piece of the same or a better rank merge one occurrence a
round, the leftmost, as the library's agenda would; a word with many of those (long runs of
blanks) ends with an agenda of its own.

Only a map over documents: no shuffle, so one hot source or group of copies costs nothing extra.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from pixelquilt.llm.common import add_columns, mix64, power_tables

#: The blank's stand-in; a fixed value of the format.
BLANK = "▁"
#: Characters encoded together: bounds a worker's memory, also within one long text.
RUN = 1 << 20
#: Occurrences of a piece that merges one by one, from which a word goes to the agenda.
MANY = 8
_NONE = np.iinfo(np.int32).max
_SLOTS = 1 << 24


class PieceBpe:
    """Encoder and decoder for a SentencePiece BPE model without normalisation rules."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize(" ﬁ  x ") != f"{BLANK}{BLANK}ﬁ{BLANK}{BLANK}x{BLANK}":
            raise ValueError("only models that keep characters and blanks and put one blank before a text")
        n = self.n = sp.vocab_size()
        self.end = sp.eos_id()
        self.unknown = sp.unk_id()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.hidden = {i for i in range(n) if sp.is_control(i)}
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        self.bytes = np.full(256, self.unknown, dtype=np.int32)
        for i in np.flatnonzero(self.is_byte).tolist():
            self.bytes[int(names[i][3:5], 16)] = i
        self.fallback = bool(self.is_byte.any())
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces aren't supported")
        own = {names[i]: i for i in range(n) if not (i in self.hidden or self.is_byte[i] or sp.is_unknown(i))}
        scores = sorted({sp.get_score(i) for i in own.values()}, reverse=True)
        place = {s: r for r, s in enumerate(scores)}
        rank = {p: place[sp.get_score(i)] for p, i in own.items()}
        #: Symbols are piece ids, and n + code point for characters that are no piece.
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int64)
        for p, i in own.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        code = lambda p: own[p] if p in own else n + ord(p) if len(p) == 1 else None
        keys, ranks, made, solo = [], [], [], set()
        for p, i in own.items():
            for j in range(1, len(p)):
                a, b = code(p[:j]), code(p[j:])
                if a is not None and b is not None:
                    keys.append(a << 21 | b)
                    ranks.append(rank[p])
                    made.append(i)
                    solo.update(rank[x] for x in (p[:j], p[j:]) if len(x) > 1 and rank[x] >= rank[p])
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys, self.ranks, self.made = np.array(keys, dtype=np.int64)[order], np.array(ranks, dtype=np.int32)[order], np.array(made, dtype=np.int64)[order]
        self.solo = np.zeros(len(scores) + 1, dtype=bool)
        self.solo[list(solo)] = True
        #: Classes of the characters in pieces, 0 for all others, and which classes stand side by side.
        self.kind = np.zeros(0x110000, dtype=np.int64)
        for k, c in enumerate(sorted({c for p in own if len(p) > 1 for c in p}), 1):
            self.kind[ord(c)] = k
        self.beside = np.zeros(_SLOTS, dtype=bool)
        for p in own:
            kinds = self.kind[[ord(c) for c in p]]
            self.beside[self._slot(kinds[:-1], kinds[1:])] = True
        self.digits = list(map(str, range(n)))
        self.surface = [bytes([int(p[3:5], 16)]) if self.is_byte[i] else b"" if i in self.hidden else " ⁇ ".encode() if i == self.unknown else p.replace(BLANK, " ").encode() for i, p in enumerate(names)]

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Two pairs of classes may share a slot: that only spares a cut."""
        return a * 4099 + b & _SLOTS - 1

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair and the piece it makes."""
        key = a << 21 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE), self.made[at]

    def _agenda(self, sym: list[int]) -> list[int]:
        """One word by single merges: best rank first, of equal ranks the leftmost."""
        n = len(sym)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def push(at: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
            r, m = self._pairs(a, b)
            for x in np.flatnonzero(r != _NONE).tolist():
                heap.append((int(r[x]), int(at[x]), int(a[x]), int(b[x]), int(m[x])))

        known: dict[tuple[int, int], tuple[int, int] | None] = {}

        def look(i: int) -> None:
            if i < 0 or after[i] >= n:
                return
            pair = sym[i], sym[after[i]]
            if pair not in known:
                r, m = self._pairs(np.array([pair[0]], dtype=np.int64), np.array([pair[1]], dtype=np.int64))
                known[pair] = (int(r[0]), int(m[0])) if r[0] != _NONE else None
            if known[pair]:
                heapq.heappush(heap, (known[pair][0], i, *pair, known[pair][1]))

        flat = np.array(sym, dtype=np.int64)
        push(np.arange(n - 1), flat[:-1], flat[1:])
        heapq.heapify(heap)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], sym[j] = m, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            look(before[i])
            look(i)
        return [s for s in sym if s >= 0]

    def merge(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words as flat symbols and their sizes; the same after all merges."""
        word, last = np.arange(len(size)), np.zeros(len(sym), dtype=bool)
        last[np.cumsum(size) - 1] = True
        rank, made = np.full(len(sym), _NONE, dtype=np.int32), np.zeros(len(sym), dtype=np.int64)
        inner = np.flatnonzero(~last)
        rank[inner], made[inner] = self._pairs(sym[inner], sym[inner + 1])
        ended: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(size):
            begin = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, begin)
            over = low == _NONE
            if over.any():
                gone = np.repeat(over, size)
                ended.append((word[over], size[over], sym[gone]))
                sym, rank, made, last = sym[~gone], rank[~gone], made[~gone], last[~gone]
                size, word, low = size[~over], word[~over], low[~over]
                if not len(size):
                    break
                begin = np.cumsum(size) - size
            at = np.flatnonzero(rank == np.repeat(low, size))
            of = np.searchsorted(begin, at, side="right") - 1
            single = self.solo[low]
            if single.any():
                slow = single & (np.bincount(of, minlength=len(size)) > MANY)
                if slow.any():
                    for w in np.flatnonzero(slow).tolist():
                        got = np.array(self._agenda(sym[begin[w] : begin[w] + size[w]].tolist()), dtype=np.int64)
                        ended.append((word[w : w + 1], np.array([len(got)]), got))
                    gone = np.repeat(slow, size)
                    sym, rank, made, last = sym[~gone], rank[~gone], made[~gone], last[~gone]
                    size, word = size[~slow], word[~slow]
                    continue
            step = np.arange(len(at))
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = at[1:] != at[:-1] + 1
            take = (step - np.maximum.accumulate(np.where(fresh, step, 0))) & 1 == 0
            first = np.ones(len(at), dtype=bool)
            first[1:] = of[1:] != of[:-1]
            take &= first | ~single[of]
            at, of = at[take], of[take]
            sym[at], last[at] = made[at], last[at + 1]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            sym, rank, made, last = sym[keep], rank[keep], made[keep], last[keep]
            size = size - np.bincount(of, minlength=len(size))
            at = at - np.arange(len(at))
            left = at[at > 0] - 1
            redo = np.concatenate([at, left[~last[left]]])
            rank[redo] = _NONE
            redo = redo[~last[redo]]
            rank[redo], made[redo] = self._pairs(sym[redo], sym[redo + 1])
        if not ended:
            return sym, size
        words, sizes, flat = (np.concatenate(x) for x in zip(*ended))
        back = np.argsort(words, kind="stable")
        return _slices(flat, (np.cumsum(sizes) - sizes)[back], sizes[back]), sizes[back]

    def _spelled(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols to ids: characters that are no piece to their bytes."""
        odd = np.flatnonzero(sym >= self.n)
        if not len(odd):
            return sym.astype(np.int32), size
        each = [self.bytes[list(chr(int(c)).encode())] if self.fallback else np.array([self.unknown], dtype=np.int32) for c in (sym[odd] - self.n)]
        wide = np.ones(len(sym), dtype=np.int64)
        wide[odd] = [len(x) for x in each]
        ends = np.cumsum(wide)
        out = np.repeat(np.where(sym < self.n, sym, 0), wide).astype(np.int32)
        out[_slices(np.arange(len(out)), ends[odd] - wide[odd], wide[odd])] = np.concatenate(each)
        return out, np.add.reduceat(wide, np.cumsum(size) - size)

    def _flat(self, points: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of code points, and how many tokens each word has; cut: where words begin."""
        sym = self.symbol[points]
        start = np.flatnonzero(cut)
        size = np.diff(start, append=len(points))
        power, inverse = power_tables(len(points) + 1)
        sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(mix64(sym.astype(np.uint64) + np.uint64(1)) * power[: len(points)], dtype=np.uint64, out=sums[1:])
        h = mix64((sums[start + size] - sums[start]) * inverse[start] + size.astype(np.uint64))
        _, one, which = np.unique(h, return_index=True, return_inverse=True)
        if not (size[one][which] == size).all() or not (_slices(sym, start[one][which], size) == sym).all():
            one, which = np.arange(len(start)), np.arange(len(start))  # two words of one hash: each by itself
        ids, count = self._spelled(*self.merge(_slices(sym, start[one], size[one]), size[one]))
        return _slices(ids, (np.cumsum(count) - count)[which], count[which]), count[which]

    def _cuts(self, points: np.ndarray) -> np.ndarray:
        kind = self.kind[points]
        cut = np.ones(len(points), dtype=bool)
        cut[1:] = ~self.beside[self._slot(kind[:-1], kind[1:])]
        return cut

    def encode_run(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without the end id."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            if len(texts[at]) > RUN:
                out.append(self._long(texts[at]))
                at += 1
                continue
            to, room = at, RUN
            while to < len(texts) and len(texts[to]) <= room:
                room -= len(texts[to])
                to += 1
            size = np.array([len(t) + (t != "") for t in texts[at:to]], dtype=np.int64)
            points = _points("".join([BLANK + t for t in texts[at:to] if t]))
            if len(points):
                cut, first = self._cuts(points), np.cumsum(size) - size
                cut[first[size > 0]] = True
                ids, count = self._flat(points, cut)
                edge = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(np.flatnonzero(cut), np.append(first, len(points)))]
                out += [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            else:
                out += [np.zeros(0, dtype=np.int32)] * (to - at)
            at = to
        return out

    def _long(self, text: str) -> np.ndarray:
        """A text in pieces of about RUN characters, each cut where no merge can cross."""
        out, rest, at = [], _points(BLANK), 0
        while at < len(text) or len(rest):
            points = np.concatenate([rest, _points(text[at : at + RUN])])
            at += RUN
            cut = self._cuts(points)
            cut[0] = True
            stop = int(np.flatnonzero(cut)[-1]) if at < len(text) else len(points)
            rest = points[stop:]
            if stop:
                out.append(self._flat(points[:stop], cut[:stop])[0])
        return np.concatenate(out)

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: control ids show nothing, the first blank goes, bytes that stand together join into characters."""
        parts: list[list[int]] = [[]]
        for i in ids:
            if i in self.hidden:
                parts.append([])
            else:
                parts[-1].append(i)
        parts = [p for p in parts if p]
        if not parts:
            return ""
        out = "".join([_text(b"".join([self.surface[i] for i in p])) for p in parts])
        first = parts[0][0]
        return out[1:] if out.startswith(" ") and not self.is_byte[first] and first != self.unknown else out


def _text(body: bytes) -> str:
    """UTF-8 as text; every byte that begins no whole character is one replacement character."""
    try:
        return body.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(body):
        for n in (1, 2, 3, 4):
            try:
                out.append(body[at : at + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\ufffd")
            n = 1
        at += n
    return "".join(out)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.replace(" ", BLANK).encode("utf-32-le"), dtype=np.uint32)


def _slices(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + size] one after another."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]


_loaded: dict[str, PieceBpe] = {}


def coder(path: str) -> PieceBpe:
    if path not in _loaded:
        _loaded[path] = PieceBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str | None = "token_ids", decoded: str | None = None, digests: bool = False, end: bool = True) -> DataFrame:
    """Each row with its token ids, and where named its decoded text or the digests of both.

    Null and empty texts have the end id alone (nothing with ``end=False``); repeated rows, null
    ids and further columns of any name pass through; a result column that exists already is
    replaced.  An empty table gives an empty one.  Texts of any length are taken whole, in
    pieces of bounded memory.  Ties of rank go to the leftmost pair.
    """
    fields = [("n_tokens", "bigint")] + [(ids, "array<int>")] * bool(ids) + [(decoded, "string")] * bool(decoded)
    fields += [("ids_sha256", "string"), ("decoded_sha256", "string")] * digests

    def work(column: pa.Array) -> Iterator[list[pa.Array]]:
        bpe = coder(path)
        for texts in text_runs(column):
            each = bpe.encode_run(texts)
            if end:
                each = [np.append(x, np.int32(bpe.end)) for x in each]
            sizes = np.array([len(x) for x in each], dtype=np.int64)
            out: list[pa.Array] = [pa.array(sizes)]
            if ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(each).astype(np.int32))))
            if decoded or digests:
                lists = [x.tolist() for x in each]
                shown = [bpe.decode(x) for x in lists]
                if decoded:
                    out.append(pa.array(shown, pa.string()))
                if digests:
                    digits = bpe.digits
                    out.append(pa.array([hashlib.sha256(" ".join([digits[i] for i in x]).encode()).hexdigest() for x in lists]))
                    out.append(pa.array([hashlib.sha256(s.encode()).hexdigest() for s in shown]))
            yield out

    return add_columns(docs, text, fields, work)


def text_runs(column: pa.Array, most: int = 4 * RUN) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``most`` characters; null reads as empty."""
    got, size = [], 0
    for x in column:
        t = x.as_py() or ""
        got.append(t)
        size += len(t)
        if size >= most:
            yield got
            got, size = [], 0
    if got:
        yield got
