"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import dataclasses
import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelquilt.llm import bpe, chats, common, decontaminate, licenses, line_dedup, lm_score, partenum, quality_rules, url_filters, warc
from pixelquilt.llm.common import materialize

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    body = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    base = "\n".join(body(rnd.randint(12, 25)) for _ in range(6))
    words = base.split(" ")
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (3, 40)]
    return [None, "", " \n\t ", "one", "One TWO three", base, base, base.upper(), *near, body(400), "\n".join([base, body(30), base]), "a " * 9000, "x" * 50000, "é ß Ünïcode " * 30, *[body(rnd.randint(5, 90)) for _ in range(12)]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 0 else "en", "s" if i % 3 else None, len(t or "")) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, (None, "no id here at all", "en", "s", 3)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def groups(pairs, ids):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


def test_ngram_join_finds_every_link(docs, none):
    def shingles(t):
        w = WORD.findall(lower(t or ""))
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())

    own = {i: shingles(t) for i, t in enumerate(texts())}
    links = [(a, b) for a, b in combinations(own, 2) if own[a] and own[b] and 100 * len(own[a] & own[b]) >= 85 * len(own[a] | own[b])]
    want = groups(links, own)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.link(docs).collect()}
    assert got.pop(None)[1] is None
    assert got == {i: (len(own[i]), want[i]) for i in own}
    assert len(set(want.values())) < len(want)
    assert partenum.link(none).count() == 0
    assert {r.doc_id for r in partenum.keep_one(docs).collect()} == {None, *want.values()}


def test_ngram_join_of_random_near_sets_at_other_thresholds(spark):
    rnd = random.Random(1)
    rows = []
    for g in range(12):
        w = [f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(8, 120))]
        for _ in range(4):
            v = list(w)
            for _ in range(rnd.randint(0, len(w) // 6)):
                v[rnd.randrange(len(v))] = f"z{rnd.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(v)))
    own = {i: {tuple(t.split()[k : k + 2]) for k in range(len(t.split()) - 1)} for i, t in rows}
    for num in (50, 80):
        want = groups([(a, b) for a, b in combinations(own, 2) if 100 * len(own[a] & own[b]) >= num * len(own[a] | own[b])], own)
        got = {r.doc_id: r.component_id for r in partenum.link(spark.createDataFrame(rows, "doc_id long, text string"), size=2, num=num).collect()}
        assert got == want, num


def test_ngram_join_of_large_sets_with_parities_of_different_lengths(spark):
    rnd = random.Random(5)
    rows = []
    for i, n in enumerate([1900, 4000, 9000]):
        base = [f"b{rnd.randint(0, 10**6)}" for _ in range(n)]
        for j, (edits, more) in enumerate([(0, 0), (n // 200, n // 12), (n // 20, 0), (n // 400, 0)]):
            w = list(base)
            for k in rnd.sample(range(n), edits):
                w[k] = f"e{rnd.randint(0, 10**6)}"
            rows.append((10 * i + j, " ".join(w + [f"m{rnd.randint(0, 10**6)}" for _ in range(more)])))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    assert len({max(32, 1 << (len(s) // 64).bit_length()) for s in sets.values()}) > 2
    comp = {i: i for i in sets}
    for a in sorted(sets):
        for b in (b for b in sorted(sets) if b > a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])):
            x, y = sorted((comp[a], comp[b]))
            comp = {i: x if c == y else c for i, c in comp.items()}
    got = {r.doc_id: r.component_id for r in partenum.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=5, num=80).collect()}
    assert got == comp and len(set(comp.values())) < len(comp) - 3


def test_partenum_plans_and_signatures_keep_every_similar_pair():
    import numpy as np

    for num, den in ((85, 100), (80, 100), (50, 100)):
        bands = partenum.Bands(num, den)
        rnd = np.random.default_rng(3)
        for n in (1, 2, 3, 5, 8, 13, 21, 40, 80, 200, 700):
            for _ in range(20):
                s = np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
                drop, add = rnd.integers(0, n + 1), rnd.integers(0, n // 4 + 2)
                t = np.union1d(rnd.choice(s, len(s) - drop // 5, replace=False), rnd.integers(0, 2**64, add, dtype=np.uint64))
                both = len(np.intersect1d(s, t))
                if not np.array_equal(s, t) and den * both >= num * (len(s) + len(t) - both):
                    assert np.intersect1d(partenum.signatures(s, bands), partenum.signatures(t, bands)).size, (num, n, len(t))
    for k in range(1, 300):
        p = partenum.plan(k, 4 * k)
        assert p.first > k // (p.errors + 1) + p.spare - (p.spare == 0) or k == 0
        assert p.first - k // (p.errors + 1) >= 1 + p.spare


def test_partenum_sets_of_a_run_go_together_and_get_their_own_signatures(monkeypatch):
    rng = np.random.default_rng(7)
    texts = [None, "", "a", "a B c", " ".join(map(str, range(5000))), *(" ".join(map(str, rng.integers(0, 99, n))) for n in rng.integers(1, 400, 60))]
    each = lambda col: [(d, b) for _, _, d, b in common.text_slices(pa.array(col, pa.string()))]
    elements, at = partenum.shingle_sets(*each(texts)[0], 4)
    for cells in (1 << 18, 1000):
        monkeypatch.setattr(partenum, "CELLS", cells)
        sigs, owners = partenum.set_signatures(elements, at, partenum.Bands(85, 100))
        hashes, parities = partenum._class_hashes(elements, at), partenum._parities(elements, at)
        for i, t in enumerate(texts):
            alone, ends = partenum.shingle_sets(*each([t])[0], 4)
            words = (t or "").lower().split()
            assert np.array_equal(alone, elements[at[i] : at[i + 1]]) and len(alone) == len({tuple(words[j : j + 4]) for j in range(max(1, len(words) - 3))} if words else ())
            assert np.array_equal(np.sort(sigs[owners == i]), np.sort(partenum.signatures(alone, partenum.Bands(85, 100))))
            assert [h[i] for h in hashes] == [h[0] for h in partenum._class_hashes(alone, ends)]
            odd = [sum(int(x) % 512 == j for x in alone) % 2 for j in range(512)]
            assert np.array_equal(parities[0][i], np.packbits(odd).view(np.uint64)) and parities[1][i] == partenum._parities(alone, ends)[1][0]


def test_python_workers_give_memory_back_and_hold_few_texts_at_once():
    import tracemalloc

    pss = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024
    held = []

    def work(source):
        for b in source:
            many = [bytes(1000) for _ in range(150_000)]
            held.append(bytes(1000))
            yield b
            del many

    before = pss()
    assert list(common.tidy(work)([1])) == [1] and pss() - before < 60
    column = pa.array([" ".join(f"word{i % 50}" for i in range(5000))] * 250)
    encoder = bpe.coder(public_tokenizers.path("word_bpe_49k.json"))
    tracemalloc.start()
    for texts in bpe.runs(column):
        encoder.encode_run(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20


def test_partenum_sets_that_are_not_similar_share_no_weak_signature():
    import numpy as np

    rnd = np.random.default_rng(11)
    fresh = lambda n: np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
    for num in (80, 85):
        bands = partenum.Bands(num, 100)
        for n in (400, 1323, 2100, 3300):
            common = fresh(1)  # one frequent shingle, and else nothing in common
            sigs = np.concatenate([np.unique(partenum.signatures(np.union1d(fresh(n), common), bands)) for _ in range(60)])
            assert len(np.unique(sigs)) == len(sigs), (num, n)


def test_partenum_signatures_keep_pairs_that_are_barely_similar():
    import numpy as np

    rnd = np.random.default_rng(12)
    fresh = lambda n: rnd.integers(0, 2**64, n, dtype=np.uint64)
    for num in (80, 85):
        bands = partenum.Bands(num, 100)
        for n in (6, 9, 20, 23, 45, 46, 70, 72, 112, 277, 432, 1323, 1654, 2067, 2584):
            for m in sorted({n, min(n + 1, n * 100 // num), n * (100 + num) // (2 * num), n * 100 // num}):
                both = -(-(n + m) * num // (100 + num))
                for _ in range(4):
                    shared = fresh(both)
                    s, t = (np.sort(np.concatenate([shared, fresh(k - both)])) for k in (n, m))
                    assert np.array_equal(s, t) or np.intersect1d(partenum.signatures(s, bands), partenum.signatures(t, bands)).size, (num, n, m)


def test_ngram_join_where_rounds_end_early(spark, monkeypatch):
    monkeypatch.setattr(partenum, "ROUNDS", 0)
    monkeypatch.setattr(partenum, "FEW_IDS", 0)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(30):
        w = list(base)
        for k in rnd.sample(range(60), rnd.randint(0, 4)):
            w[k] = f"z{rnd.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    own = {i: {tuple(t.split()[k : k + 2]) for k in range(59)} for i, t in rows}
    want = groups([(a, b) for a, b in combinations(own, 2) if 100 * len(own[a] & own[b]) >= 85 * len(own[a] | own[b])], own)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit(1)).withColumn("c1", F.lit("x")).withColumn("a.b", F.lit(2))
    assert {r.doc_id: r.component_id for r in partenum.link(docs, size=2).collect()} == want
    assert partenum.keep_one(docs, size=2).columns == docs.columns


def test_line_dedup_with_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b\nc d", 5, "x", 1, 2), (2, "c d\ne f", 6, "y", 1, 2), (2, "c d\ne f", 6, "y", 1, 2)], ["doc_id", "text", "h", "_h", "gone", "a.b"])
    got = line_dedup.dedup(docs)
    assert got.columns == ["doc_id", "text", "h", "_h", "a.b", "n_lines", "gone"]
    assert sorted((r.doc_id, r.text, r.h, r._h) for r in got.collect()) == [(1, "a b\nc d", 5, "x"), (2, "e f", 6, "y"), (2, "e f", 6, "y")]


def test_counts_beyond_32_bits(spark):
    import numpy as np

    big = (1 << 32) - 1
    runs = [(1, 0, b"", np.array([7], dtype=np.uint64).tobytes() + np.array([big], dtype=np.uint32).tobytes())] * 3
    row = lm_score._blocks(spark.createDataFrame(runs, "kind int, bucket int, ones binary, more binary"), 16).first()
    block = lm_score.Block(0, 16, [row])
    assert block.count(np.array([7, 8], dtype=np.uint64)).tolist() == [3 * big, 0]


def test_line_dedup_against_all_pairs(docs, none):
    seen, gone = [], {}
    for i, t in enumerate(texts()):
        for k, line in enumerate((t or "").split("\n")):
            s = set(WORD.findall(line.lower()))
            if s:
                if any(10 * len(s & o) >= 9 * len(s | o) for o in seen):
                    gone.setdefault(i, []).append(k)
                seen.append(s)
    out = {r.doc_id: r for r in line_dedup.dedup(docs).collect()}
    assert {i: r.gone for i, r in out.items() if r.gone} == gone and len(gone) > 4
    for i, t in enumerate(texts()):
        assert out[i].text == (t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, [])))
        assert out[i].n_lines == (0 if t is None else len(t.split("\n")))
    assert line_dedup.dedup(none).count() == 0


def test_line_dedup_asks_for_the_second_word_under_hot_words(spark, monkeypatch):
    rnd = random.Random(2)
    rows = []
    for i in range(60):
        w = ["rare", "seldom"] + [f"v{rnd.randint(0, 60)}" for _ in range(24)]
        if i % 4 == 3:
            w = [*rows[-1][1].split()[:-1], "other"]
        rows.append((i, " ".join(w)))
    sets = [set(t.split()) for _, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for num, den, few, hot, asked in ((9, 10, 1, 2, 0), (8, 10, 8, 64, 200_000), (1, 2, 1, 2, 200_000)):
        want = {i for i in range(60) if any(den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]) for j in range(i))}
        for name, value in (("FEW", few), ("HOT", hot), ("ASKED", asked)):
            monkeypatch.setattr(line_dedup, name, value)
        got = {r.doc_id for r in line_dedup.dedup(docs, num, den).where("size(gone) > 0").collect()}
        assert got == want and len(want) >= 8, (num, few, hot)


def test_line_dedup_of_many_near_copies_of_one_line(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 5)
    rnd = random.Random(7)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(80):
        w = list(base)
        for k in rnd.sample(range(40), rnd.choice([1, 2, 3, 4])):
            w[k] = f"n{rnd.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base)) for i in range(5)]
    sets = [set(t.split()) for _, t in rows]
    want = {i for k, (i, _) in enumerate(rows) if any(10 * len(sets[k] & s) >= 9 * len(sets[k] | s) for s in sets[:k])}
    got = {r.doc_id for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).where("size(gone) > 0").collect()}
    assert got == want and 5 < len(want) < 85


def test_line_dedup_of_long_lines(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for i in range(60):
        w = rnd.sample(words, rnd.choice([150, 162, 260, 400]))
        if i % 3:  # on both sides of the similarity, and of the size from which more parities are kept
            w = list(rnd.choice(rows[: 3 * (i // 3) + 1])[1].split())
            for k in rnd.sample(range(len(w)), int(len(w) * rnd.uniform(0.0, 0.09))):
                w[k] = f"n{rnd.randint(0, 10**6)}"
            w = w[rnd.randint(0, len(w) // 25) :]
        rows.append((i, " ".join(w)))
    sets = [set(t.split()) for _, t in rows]
    want = {i for i in range(60) if any(10 * len(sets[i] & s) >= 9 * len(sets[i] | s) for s in sets[:i])}
    got = {r.doc_id for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).where("size(gone) > 0").collect()}
    assert got == want and 5 < len(want) < 40


def test_line_dedup_takes_repeats_of_short_lines(spark):
    lines = ["Read more", "", "---", "buy", " ", "read  MORE read", "buy buy", "---", "", "a " * 9000, "Read", "more read", "A a", "--- x", "\t"]
    rows = [(0, "\n".join(lines)), (1, "buy"), (2, ""), (3, "sell\n\n\nsell")]
    seen, gone = [], {}
    for i, t in rows:
        for k, line in enumerate(t.split("\n")):
            s = set(WORD.findall(line.lower()))
            if s and s in seen:
                gone.setdefault(i, []).append(k)
            seen.append(s)
    got = {r.doc_id: r.gone for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: g for i, g in got.items() if g} == gone == {0: [5, 6, 7, 11, 12], 1: [0], 3: [3]}


def test_rarity_of_words_and_packed_prefix_rows(spark):
    """A word of one line doesn't pass for the frequent one 2^18 further; a row's size, position and bit come back."""
    lines = spark.createDataFrame([([5, 5 + (1 << 18), -1],)] + [([5 + (1 << 18), 7 - (1 << 62)],)] * 99, "words array<long>")
    levels = line_dedup.rarity_levels(lines)
    assert [levels[w % len(levels)] for w in (5, 5 + (1 << 18), -1, 7, 8)] == ["3", "19", "3", "19", "0"]
    top = (1 << 31) - 1
    rows = spark.createDataFrame([(n, at, home) for n in (9, top) for at in (0, n - 1) for home in (False, True)], "n int, at int, home boolean")
    rows = rows.withColumn("spot", line_dedup._spot("n", "at", "home")).alias("a")
    back = rows.selectExpr("n", "at", "home", f"{line_dedup._n('a')} as n2", f"{line_dedup._at('a')} as at2", "spot & 1 as home2").collect()
    assert len(back) == 8 and all((r.n, r["at"], int(r.home)) == (r.n2, r.at2, r.home2) for r in back)
    #: Pairs by products are those by the least overlap, rounded up.
    sim = line_dedup.Similarity(9, 10)
    cases = [(n, m, x) for n in range(1, 45) for m in range(1, 45) for x in range(abs(n - m), min(n + m, 10) + 1, 2)]
    sides = [F.struct(line_dedup._spot(n, "0", "true").alias("spot"), F.expr(sig).alias("sig"), F.expr("cast(null as struct<p1:bigint,p2:bigint,p3:bigint>)").alias("odd")).alias(side) for side, n, sig in (("a", "n", "shiftleft(1L, x) - 1"), ("b", "m", "0L"))]
    got = {(r.n, r.m, r.x) for r in spark.createDataFrame(cases, "n int, m int, x int").select("n", "m", "x", *sides).where(sim.fits(1)).collect()}
    assert got == {(n, m, x) for n, m, x in cases if 10 * min(n, m) >= 9 * max(n, m) and 19 * (n + m - x) // 2 >= 9 * (n + m)} and len(got) > 200


def test_rarity_levels_are_no_part_of_a_plan(spark):
    """Plans stay short whatever the table, no row carries it, and words come in the order of their levels."""
    rows = [(0, 1, 0, 1, 1, [-1, 5, 6, 9]), (0, 1, 1, 2, 2, [7 - (1 << 62)]), (1, 1, 0, 2, 2, [7 - (1 << 62)])]
    lines = spark.createDataFrame(rows, "doc_id long, h long, line int, c1 long, c2 long, words array<long>")
    levels = ["0"] * line_dedup.BUCKETS
    levels[5], levels[6], levels[line_dedup.BUCKETS - 1] = "127", "3", "7"
    classes = line_dedup._classes(lines, levels, line_dedup.Similarity(1, 10))
    plan = classes._jdf.queryExecution()
    assert len(plan.toString()) < 50_000
    assert plan.optimizedPlan().toString().count("AS levels") == 0
    low = (1 << line_dedup.BITS) - 1
    got = {r.c1: [(w >> line_dedup.BITS, w & low) for w in r.words] for r in classes.collect()}
    assert got == {1: [(0, 9), (3, 6), (7, low), (127, 5)], 2: [(0, 7)]}


def test_component_rounds_release_what_they_leave(spark, monkeypatch):
    from pixelquilt.llm import components as module

    calls = []
    monkeypatch.setattr(module, "release", lambda session: calls.append(1))
    n = 40
    order = [(k * 17) % n for k in range(n)]
    got = module.components(spark.createDataFrame([*zip(order[:-1], order[1:])], "a long, b long")).collect()
    assert {(r.node, r.component) for r in got} == {(k, 0) for k in range(n)} and len(calls) >= 2


def test_decontamination_and_its_parts(spark, docs, none):
    bench = spark.createDataFrame([(1, texts()[10][:600]), (2, "ONE two; three"), (3, None), (4, ""), (10, "one two three"), (None, "x")], "item_id long, text string")
    for most in (500_000, 7):
        got = {r.doc_id: r for r in decontaminate.find(docs, bench, most=most).collect()}
        assert got[4].hit_items == ["10", "2"] and got[4].n_hit == 3 and got[4].items_sha256 == hashlib.sha256(b"10,2").hexdigest()
        assert got[10].contaminated and got[10].hit_items == ["1"] and not got[5].contaminated and got[0].n_words == 0
    empty = decontaminate.find(docs, bench.limit(0))
    assert empty.where("contaminated").count() == 0 and empty.count() == len(texts()) + 1
    assert decontaminate.find(none, bench).count() == 0
    assert decontaminate.clean(docs, bench).columns == docs.columns


def test_tokens_are_those_of_the_library(spark, docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    more = ["", None, "It's I'M we'll they've 'tis '' 's", "ﬁ ǅ İstanbul ΣΑΣ", "<|endoftext|>x<|startoftext|>", "日本語 текст 🙂👍🏽", " a b\x1cc\x85d", "1234 5.6%", "aaaa aaaaa" * 50, "é ẞ", "\0 �"]
    extra = spark.createDataFrame([(100 + i, x, None, None, 0) for i, x in enumerate(more)], DOCS)
    out = bpe.encode(docs.union(extra), path, ids="ids", decoded="back", digests=True)
    for r in out.collect():
        e = t.encode(r.text or "", add_special_tokens=False)
        assert r.ids == e.ids, r.text
        assert r.back == t.decode(e.ids, skip_special_tokens=False) and r.n_tokens == len(e.ids)
    assert bpe.encode(none, path).count() == 0


def test_base_scores_of_the_model(spark, docs, none):
    own = {i: [*WORD.findall(lower(t or "")), None] for i, t in enumerate(texts())}
    own[None] = ["no", "id", "here", "at", "all", None]
    held = {i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 for i in own}
    counts = Counter(w for i, ws in own.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in lm_score.score(docs).collect()}
    blocks = {r.doc_id: r for r in lm_score.score(docs, most=2000).collect()}
    for i, ws in own.items():
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(counts[w] > 0 for w in ws), n, held[i])
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score <= 0
        assert blocks[i].score == pytest.approx(r.score, rel=1e-9) and blocks[i].n_known == r.n_known
    assert lm_score.score(none).count() == 0


@pytest.mark.parametrize("bits", [lm_score.BITS_AN_ENTRY, 4096])
def test_scores_against_counted_bigrams(spark, docs, monkeypatch, bits):
    """With room for no false probe the filter's scores are those of counted bigrams; with the usual room errors only raise them, and little."""
    monkeypatch.setattr(lm_score, "BITS_AN_ENTRY", bits)
    own = [(i, t) for i, t in enumerate(texts())] + [(None, "no id here at all")]
    own = [(i, [*WORD.findall(lower(t or "")), "\0end"]) for i, t in own]
    train = [ws for i, ws in own if zlib.crc32(str("" if i is None else i).encode()) % 10]
    words = Counter(w for ws in train for w in ws)
    pairs = Counter(p for ws in train for p in zip(["\0start", *ws], ws))
    n, v = sum(words.values()), len(words)

    def log_p(before, w):
        unigram = (words[w] + 0.1) / (n + 0.1 * (v + 1))
        c, seen = pairs[before, w], len(train) if before == "\0start" else words[before]
        level = c.bit_length()
        middle = 0 if c == 0 else 1 if c == 1 else 2 ** (level - 0.585)
        return math.log10(0.6 * min(1, middle / seen if seen else 0) + 0.4 * unigram)

    got = {r.doc_id: r.score for r in lm_score.score(docs).collect()}
    want = {i: sum(log_p(*p) for p in zip(["\0start", *ws], ws)) for i, ws in own}
    tokens = sum(len(ws) for _, ws in own)
    assert got.keys() == want.keys() and all(got[i] >= want[i] - 1e-9 * abs(want[i]) for i in want)
    assert sum(got[i] - want[i] for i in want) < (0.1 * tokens if bits < 4096 else 1e-6)


def test_the_model_prefers_word_order_it_has_seen(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    after = {w: rnd.sample(words, 3) for w in words}

    def walk(n):
        out = [rnd.choice(words)]
        while len(out) < n:
            out.append(rnd.choice(after[out[-1]]))
        return out

    rows = [(i, " ".join(walk(60))) for i in range(300)]
    mixed = [(1000 + i, " ".join(rnd.sample(w := walk(60), len(w)))) for i in range(300)]
    got = lm_score.score(spark.createDataFrame(rows + mixed, "doc_id long, text string")).where("held_out").select((F.col("doc_id") >= 1000).alias("mixed"), (F.col("score") / F.col("n_tokens")).alias("s")).groupBy("mixed").agg(F.avg("s")).collect()
    means = dict(map(tuple, got))
    assert means[False] > means[True] + 0.1


def test_licenses(spark, none):
    rows = ["under the MIT License, and the mit\nlicense", "Apache License, Version 2.0", "GNU General Public License version 3 or later", "SPDX-License-Identifier: BSD-3-Clause", "nothing here", None, ""]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = [r for r in licenses.scan(docs).orderBy("doc_id").collect()]
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (2, 2, 6, "mit")
    assert got[1].base_labels == "apache" and "apache-2.0" in got[1].labels.split(",")
    assert "gpl-3.0-or-later" in got[2].labels.split(",") and got[2].base_labels == "gpl"
    assert got[3].labels == "bsd-3-clause" and got[3].n_base == 0 and got[3].score == 1
    assert all((r.labels, r.n_base, r.first_word, r.score) == ("", 0, None, 0) for r in got[4:])
    assert len(licenses.rules()) > 300
    assert licenses.scan(none).count() == 0
    spans = [(d.start, d.end, d.priority) for d in got[2].detections]
    assert not any(a != b and a[0] <= b[0] and b[1] <= a[1] and a[2] > b[2] for a in spans for b in spans)


def test_base_license_phrases_of_random_texts_against_every_place(spark):
    rnd = random.Random(8)
    parts = ["mit", "MIT", "license", "License", "licenses", "apache", "general", "public", "GENERAL Public License", "mit license", "mitlicense", "é", "mité", "0", "_", "\x00", "\u2028", "license\u00a0mit"]
    rows = ["".join(rnd.choice(parts) + rnd.choice([" ", "\n * ", "-", "", ", ", "  "]) for _ in range(rnd.choice([0, 3, 30, 300]))) for _ in range(120)]
    rows += [rows[7], "general public license " * 20000, None]
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    got = licenses.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    for r in got:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(rows[r.doc_id] or ""))
        places = [(i, label) for i in range(len(ws)) for phrase, label in phrases.items() if tuple(ws[i : i + len(phrase)]) == phrase]
        labels = {label for _, label in places}
        want = (len(ws), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(labels)))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want, rows[r.doc_id]
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score >= 0.6 or not labels)


def test_license_keywords_let_every_match_through():
    scanner = licenses.Scanner()
    rows = ["distributed under the gnu gpl.", "released under cc0", "all rights\n * reserved", "all  rights  reserved", "the public\n// domain", "creative  commons zero", "boost software\n# license", "gnu free  documentation license 1.2", "do what the fuck you want to public license", "\u201cmpl-2.0\u201d", "all\u00a0rights\u00a0reserved", "the gnu lgpl", "gnu agpl", "xspdx-license-identifier: mit", "the gnu lesser general\n *  public license, version 2.1", "nothing of the kind", ""]
    for t in rows:
        every = {scanner.ordered[i].label for i, c in enumerate(scanner.compiled) if c.search(t)}
        found = scanner.detect(t)
        assert bool(every) == bool(found) and {d.rule.label for d in found} <= every, t
        free = licenses.Scanner()
        free.names, free.strings = {b"": list(range(len(free.ordered)))}, {}
        assert found == free.detect(t), t
    assert {d.rule.label for d in scanner.detect(rows[0])} == {"gpl"} and {d.rule.label for d in scanner.detect(rows[1])} == {"cc0"}
    assert {d.rule.label for d in scanner.detect(rows[2])} == {"all-rights-reserved"} and not scanner.detect(rows[-2])


def test_quality_rules(docs, none):
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for i, t in enumerate(texts()):
        w = WORD.findall(t or "")
        places = {}
        for k in range(len(w) - 2):
            places.setdefault(tuple(w[k : k + 3]), []).append(k)
        repeat = {x for ks in places.values() if len(ks) > 1 for k in ks for x in (k, k + 1, k + 2)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(repeat)), i
        assert r.base_failed == (len(w) < 50 or 100 * len(repeat) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    assert quality_rules.judge(none).count() == 0
    assert quality_rules.clean(docs).columns == docs.columns


def test_quality_thresholds_reject_what_stands_out(spark):
    rnd = random.Random(4)
    text = lambda f: " ".join("".join(rnd.choice("abcdefgh") for _ in range(f())) for _ in range(80))
    rows = [(i, text(lambda: rnd.randint(3, 7)), "en", "s", 1) for i in range(300)] + [(999, text(lambda: 40), "en", "s", 1), (1000, "$ | # " * 60 + text(lambda: 5), "en", "t", 1)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert not got.pop(999) and not got.pop(1000) and all(got.values())


def test_quality_repetition_fences_follow_the_group(spark):
    rnd = random.Random(8)
    line = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    body = lambda n: [line(12) for _ in range(n)]
    rows = []
    for i in range(300):
        clean, songs = body(10), body(12)
        rows += [(i, "\n".join(clean), "en", "clean", 1), (1000 + i, "\n".join([*songs, *songs[:2]]) if i % 10 == 0 else "\n".join(songs), "en", "songs", 1)]
    one, two, three = body(4), body(10), body(10)
    rows += [(5000, "\n".join([*one, one[0]]), "en", "clean", 1), (5001, "\n".join([*two, *two[:2]]), "en", "clean", 1), (5002, "\n".join([*three, *three[:3]]), "en", "songs", 1)]
    phrase = line(6)
    rows += [(5003, line(60) + " ".join([" "] + [phrase + " " + line(6)] * 2), "en", "clean", 1), (5004, line(60) + " w1 w2 w3 " + line(3) + " w1 w2 w3", "en", "clean", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {5001, 5002, 5003}
    limits = {r.source: (r.dup_line_rate_hi, r.repeat_rate_hi) for r in quality_rules.thresholds(materialize(quality_rules.base_metrics(docs), "measured")).collect()}
    assert limits["clean"] == (500, 500) and all(a > b for a, b in zip(limits["songs"], limits["clean"]))


def test_warc_round_trip_and_order(spark):
    rows = [(1, "http://A.example.com/b?q=1", "x"), (2, "http://a.example.com/b?q=1", "x"), (3, None, None), (4, "no scheme", ""), (5, "http://b.example.com/\r\nInjected: 1", "é" * 1000), (None, "http://c.example.com", "n"), (6, "http://a.example.com/a", "x")]
    out = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    got = out.collect()
    assert [(r.url_key, r.captured, r.page_id or -1) for r in got] == sorted((r.url_key, r.captured, r.page_id or -1) for r in got)
    by = {r.page_id: r for r in got}
    assert [(by[i].record_type, by[i].refers_to) for i in (1, 2, 6, 3, 4)] == [("revisit", 6), ("revisit", 6), ("response", None), ("revisit", 4), ("response", None)]
    assert by[5].payload_bytes == 2000 and by[3].payload_digest == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert len(got) == len(rows)
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("runs, parts", [(1, 3), (7, 4), (40, 1)])
def test_index_of_sorted_runs_with_ties_and_a_hot_url(spark, runs, parts, monkeypatch):
    """Runs in order, one with its order broken, a URL of a third of all captures, repeated captures and null ids."""
    monkeypatch.setattr(warc, "SAMPLES", 5)
    rnd = random.Random(runs)
    rows = []
    for i in range(2000):
        url = "org,hot)/" if i % 3 == 0 else f"org,{rnd.randint(0, 50)})/é{rnd.randint(0, 9)}"
        page = None if i % 41 == 0 else rnd.randint(0, 300)
        rows.append((page, url, f"2024-01-{rnd.randint(1, 9):02d}", f"part-{rnd.randrange(runs)}", i, 1, "D", "response", None))
    key = lambda r: (r[1], r[2], r[0] is not None, r[0] or 0, r[3], r[4])
    sorted_runs = sorted(rows, key=lambda r: (r[3], key(r)))
    sorted_runs[3:9] = reversed(sorted_runs[3:9])
    out = warc.merge_index(spark.createDataFrame(sorted_runs, warc._CAPTURE).coalesce(2), parts)
    got = [tuple(r) for r in out.collect()]
    assert got == sorted(rows, key=key) and out.rdd.getNumPartitions() == parts
    sizes = [n for n in out.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()]
    assert max(sizes) < 2 * 2000 / parts + 1
    assert warc.merge_index(spark.createDataFrame([], warc._CAPTURE)).count() == 0


def test_loser_tree():
    rnd = random.Random(6)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted(rnd.randint(0, 9) for _ in range(rnd.randint(0, 8))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(sum(runs, []))


def test_chats(spark, monkeypatch):
    monkeypatch.setattr(chats, "BLOCK", 2)
    logs = {1: "ab", 2: "abc", 3: "abcde", 4: "abcde", 5: "abd", 6: "x", 7: "bc"}
    rows = [(i, k, None if c == "x" else "user", None if c == "d" else c) for i, s in logs.items() for k, c in enumerate(s)]
    turns = spark.createDataFrame([*rows, (None, 0, "user", "a"), (8, None, "user", "a")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.kept, r.covered_by) for r in chats.collapse(turns).collect()}
    assert got == {1: (2, False, 3), 2: (3, False, 3), 3: (5, True, None), 4: (5, False, 3), 5: (3, True, None), 6: (1, True, None), 7: (2, True, None), 8: (1, False, 3)}
    parts = chats.render(turns, chats.collapse(turns).where("kept")).where("conv_id = 3").orderBy("part").collect()
    assert len(parts) == 3 and "".join(p.text for p in parts) == "".join(f"<|im_start|>user\n{c}<|im_end|>\n" for c in ["a", "b", "c", "", "e"])
    assert chats.collapse(turns.limit(0)).count() == 0
    assert spark.range(1).select(chats.turn_text(F.lit("user"), F.lit("<|im_end|>"))).first()[0].count("<|im_end|>") == 1


def test_url_rules_and_purity(spark):
    urls = ["http://x.com/en/1", "https://www.Example.com/en/2", "http://a.example.com/en/3", "http://example.com/de/4", "http://s.net/es/5", "http://s.net/esp", "http://snet/es/", "http://y.org", None, "nothing", "http://z.com?a=/x#b"]
    got = [r for r in url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert [r.rule for r in got] == ["com/", "www.example.com/en/", "example.com/en/", "com/", "net/es/", None, None, None, None, None, None]
    assert [r.verdict for r in got[:5]] == ["allow", "allow", "block", "allow", "block"] and (got[10].host, got[10].path) == ("z.com", "") and (got[8].host, got[8].path) == ("", "")
    many = [(i, f"http://h.org/{'spam' if i % 2 else 'good'}/item-{i}x/{i}") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2 == 0) for i in range(0, 120)], "page_id long, good boolean")
    got = url_filters.judge(spark.createDataFrame(many, "page_id long, url string"), labels).collect()
    assert all(r.verdict == ("block" if r.page_id % 2 else "allow") for r in got)
    assert {r.template for r in got} == {"/spam/<mixed>/<n>", "/good/<mixed>/<n>"}
    pages = spark.createDataFrame([(i, f"http://h.org/{'abc'[i % 3]}/item-{i}x/{i}") for i in range(300)], "page_id long, url string")
    assert {r.template for r in url_filters.judge(pages).collect()} == {"/{a}/<mixed>/<n>"}
    assert url_filters.judge(pages.limit(0)).count() == 0


def test_url_templates_go_to_the_last_segment(spark):
    deep = [(i, f"http://h.org/blog/2024/05/12/{'spam-offer' if i % 2 else 'report'}/{'a/' * (i % 5)}{i}") for i in range(120)]
    deep += [(1000 + i, f"http://k.org/x/y/z/u/v/w/item-{'abcdefghijkl'[i]}") for i in range(12)] + [(2000, "http://l.org/p/q/r/s/5/t/u/6.html")]
    deep += [(3000 + i, f"http://g.org/1/2/3/4/5/{'ab'[i % 2]}/{'cd'[i // 2 % 2]}") for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2 == 0) for i in range(120)], "page_id long, good boolean")
    got = {r.page_id: r for r in url_filters.judge(spark.createDataFrame(deep, "page_id long, url string"), labels).collect()}
    assert len(got) == len(deep)
    assert all(got[i].verdict == ("block" if i % 2 else "allow") for i in range(120))
    assert got[0].template == "/blog/<n>/<n>/<n>/report/<n>" and got[1].template == "/blog/<n>/<n>/<n>/spam-offer/a/<n>"
    assert {got[1000 + i].template for i in range(12)} == {"/x/y/z/u/v/w/<word>"} and got[2000].template == "/p/q/r/s/<n>/t/u/<n.>"
    assert {got[3000 + i].template for i in range(80)} == {"/<n>/<n>/<n>/<n>/<n>/{a}/{c}"}


def plain_clusters(branches):
    """{b: leader} of one node's branches {b: (lean, Counter of next segments)}, from the definition."""
    lead = {}
    for b in sorted(branches, key=lambda b: (-sum(branches[b][1].values()), b)):
        lean, own = branches[b]
        n, lead[b] = sum(own.values()), b
        for first in [x for x in lead if lead[x] == x and x != b]:
            other = branches[first][1]
            m, keys = sum(other.values()), own.keys() | other.keys()
            x2 = sum((m * own[k] - n * other[k]) ** 2 / (own[k] + other[k]) for k in keys) / m / n
            free = len(keys) - 1
            near = x2 <= free + 3 * math.sqrt(2 * free) + 0.04 * m * n / (m + n) and sum(min(own[k] / n, other[k] / m) for k in keys) >= 0.5
            if near and branches[first][0] == lean:
                lead[b] = first
                break
    return lead


def test_url_branches_merge_with_their_like_alone(spark):
    """Two pairs of twins under one node merge as two pairs, whatever else stands there; other leanings and few URLs stay apart."""
    urls = [f"http://h.org/{b}/{x}/{i}" for b, x in [("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")] for i in range(100)]
    urls += [f"http://h.org/e/{'xy'[i % 2]}/{i}" for i in range(100)] + ["http://h.org/f/z/1", "http://h.org/g/w/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {re.sub("[0-9]+$", "", u): r.template for u, r in zip(urls, url_filters.judge(pages).orderBy("page_id").collect())}
    assert got["http://h.org/a/x/"] == got["http://h.org/b/x/"] == "/{a}/x/<n>" and got["http://h.org/c/y/"] == got["http://h.org/d/y/"] == "/{c}/y/<n>"
    assert got["http://h.org/f/z/"] == "/f/z/<n>" and got["http://h.org/g/w/"] == "/g/w/<n>"
    assert len({got["http://h.org/e/x/"], got["http://h.org/e/y/"]} & {"/{a}/x/<n>", "/{c}/y/<n>"}) == 0
    labels = spark.createDataFrame([(i, i < 100 or i >= 300) for i in range(400)], "page_id long, good boolean")
    got = {r.page_id: (r.template, r.verdict) for r in url_filters.judge(pages, labels).collect()}
    assert got[0][0] == "/a/x/<n>" and got[100] == ("/b/x/<n>", "block") and got[200] == ("/c/y/<n>", "block") and got[300] == ("/d/y/<n>", "allow")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_url_clusters_of_random_trees_against_their_definition(spark, seed):
    rnd = random.Random(seed)
    kinds = [[rnd.random() ** 3 for _ in range(4)] for _ in range(3)]
    paths = Counter()
    for _ in range(3000):
        host, depth = rnd.choice("hhk"), rnd.choice([2, 3, 5, 6])
        path = []
        for at in range(depth):
            path.append(rnd.choices("abcd", kinds[(ord(path[-1][0]) if path else 0) % 3])[0] + "xyzuvw"[at])
        paths[host, "/" + "/".join(path)] += rnd.choice([1, 1, 1, 30])
    rows = [(h, p, n, rnd.choice([0, n]), 0) for (h, p), n in sorted(paths.items())]
    rows = [(h, p, n, g, n - g) for h, p, n, g, _ in rows]
    want = {(h, p): p[1:].split("/") for h, p, *_ in rows}
    for d in range(6, 0, -1):
        nodes = {}
        for h, p, n, g, k in rows:
            t = want[h, p]
            if len(t) >= d:
                node = nodes.setdefault((h, *t[: d - 1]), {}).setdefault(t[d - 1], [0, 0, Counter()])
                node[0], node[1] = node[0] + g, node[1] + k
                node[2]["" if len(t) == d else "{*}" if t[d][0] == "{" else t[d]] += n
        for node, branches in nodes.items():
            lead = plain_clusters({b: (g >= k, c) for b, (g, k, c) in branches.items()})
            several = {x for x, n in Counter(lead.values()).items() if n > 1}
            for h, p, *_ in rows:
                t = want[h, p]
                if len(t) >= d and (h, *t[: d - 1]) == node and lead[t[d - 1]] in several:
                    t[d - 1] = "{" + lead[t[d - 1]] + "}"
    got = {(r.host, r.template): r.into for r in url_filters.merged(spark.createDataFrame(rows, "host string, template string, n long, good long, bad long")).collect()}
    assert got == {k: "/" + "/".join(t) for k, t in want.items()} and any("{" in x for x in got.values())


def test_the_pipeline_on_its_own_documents(spark, docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    bench = texts()[10]
    rows = docs.where("doc_id is not null").collect()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(bench.split()[20:60]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [set(r.doc_id for r in at.collect())]
    for name, stage in pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        seen.append({r.doc_id for r in at.collect()})
        assert seen[-1] <= seen[-2]
        if name == "decontaminate":
            before = {r.doc_id: r.text for r in at.collect()}
    assert 10 not in seen[4] and 10 in seen[3] and seen[5] == seen[4] and seen[5]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id: r.token_ids for r in at.collect()} == {i: t.encode(x, add_special_tokens=False).ids for i, x in before.items()}
    assert {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()} == seen[5]


# --- any columns, any ids -----------------------------------------------------------------------

ODD = "`a.b` string, `c``d` int, in_0 int, in_text string, out_0 long, h long, gone int, place string, words string, doc_id long, text string, lang string, source string, n_chars long, component_id long"


def odd_rows(n=40):
    rnd = random.Random(12)
    body = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(60))
    rows = [("x", i, 1, "t", 2, 3, 4, "p", "w", i, body(), "en", "s", 5, 6) for i in range(n)]
    return rows + [rows[3], rows[3]] + [("x", 0, 1, "t", 2, 3, 4, "p", "w", None, None, None, None, None, 6)]


@pytest.mark.parametrize("name", ["bpe", "decontaminate", "decontaminate_clean", "licenses", "quality", "quality_clean", "lines", "lines_clean", "near_clean"])
def test_operators_pass_columns_of_any_name_through(spark, name):
    df = spark.createDataFrame(odd_rows(), ODD).repartition(2)
    bench = spark.createDataFrame([("i1", " ".join(odd_rows()[5][10].split()[3:20]))], "`item.id` string, `its text` string")
    bench_of = {"item": "item.id", "item_text": "its text"}
    run = {
        "bpe": lambda: bpe.encode(df, public_tokenizers.path("word_bpe_49k.json")),
        "decontaminate": lambda: decontaminate.find(df, bench, **bench_of),
        "decontaminate_clean": lambda: decontaminate.clean(df, bench, **bench_of),
        "licenses": lambda: licenses.scan(df),
        "quality": lambda: quality_rules.judge(df),
        "quality_clean": lambda: quality_rules.clean(df),
        "lines": lambda: line_dedup.dedup(df),
        "lines_clean": lambda: line_dedup.clean(df),
        "near_clean": lambda: partenum.keep_one(df, size=5, num=80, den=100),
    }[name]
    out = run()
    kept = [c for c in df.columns if c in out.columns]
    assert set(df.columns) - set(kept) <= {"gone"} and (not name.endswith("clean") or out.columns == df.columns)
    rows = out.select(*[f"`{c.replace('`', '``')}`" for c in kept]).collect()
    known = {r[9]: r for r in odd_rows() if r[9] is not None}
    place = {c: i for i, c in enumerate(df.columns)}
    same = [c for c in kept if c not in ("gone", "n_chars", "text")]
    assert len(rows) == {"quality_clean": 42, "lines_clean": 43, "decontaminate_clean": 42}.get(name, len(rows)) and len(rows) >= 40
    for r in rows:
        if r["doc_id"] is not None:
            assert all(r[c] == known[r["doc_id"]][place[c]] for c in same)


def test_lines_of_documents_with_ids_of_any_type(spark):
    rnd = random.Random(3)
    line = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(20)) for _ in range(12)]
    near = [" ".join([*x.split()[:19], "other"]) for x in line]
    texts_ = [line[i] if i < 12 else near[i - 12] for i in range(24)]
    for kind, name in (("string", lambda i: f"doc-{i:03}"), ("string", lambda i: "ü" * (i + 1)), ("double", lambda i: i / 2), ("date", None), ("long", lambda i: i)):
        ids = [datetime.date.fromordinal(700_000 + i) if name is None else name(i) for i in range(24)]
        df = spark.createDataFrame(list(zip(ids, texts_)), f"doc_id {kind}, text string").repartition(3)
        got = {r["doc_id"]: r["gone"] for r in line_dedup.dedup(df).collect()}
        assert [got[i] for i in ids] == [[]] * 12 + [[0]] * 12, kind


# --- thresholds, overlaps -------------------------------------------------------------------------


def test_what_the_quality_rules_keep_against_plain_thresholds(spark):
    """The method spelled out in Python: buckets, quantiles of each group, fences, what is tested."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9)))
    rows = []
    for i in range(260):
        group = rnd.choice([("en", "a"), ("en", "b"), ("de", "a"), ("fr", None), (None, "z")])
        lines = [" ".join(word() for _ in range(rnd.randint(4, 12))) for _ in range(rnd.randint(4, 14))]
        lines += [rnd.choice(lines) for _ in range(rnd.choice([0, 0, 0, 1, 2, 4]))]
        if rnd.random() < 0.3:
            lines.append("# $ | " * rnd.randint(1, 25))
        rows.append((i, "\n".join(lines), *group, 1))
    bucket = lambda v: v if v < 64 else v >> v.bit_length() - 6 << v.bit_length() - 6
    measured = {}
    for i, t, lang, source, _ in rows:
        w, ls = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        places = {}
        for k in range(len(w) - 2):
            places.setdefault(tuple(w[k : k + 3]), []).append(k)
        repeat = len({x for ks in places.values() if len(ks) > 1 for k in ks for x in (k, k + 1, k + 2)})
        dup = len(ls) - len(set(ls))
        echo = len(WORD.findall(next(x for x in ls if ls.count(x) > 1))) if dup == 1 else 0
        n = len(w)
        values = [sum(map(len, w)) * 100 // n, sum(c in "#*$%&|<>" for c in t) * 10000 // n, dup * 10000 // len(ls), repeat * 10000 // n]
        tested = [*values[:2], 0 if dup == 1 else values[2], max(repeat - max(2 * echo, 6), 0) * 10000 // n]
        measured[i] = (lang or "", source or "", n < 50 or 100 * repeat > 50 * n, values, tested)
    at = lambda xs, q: next(x for k, x in enumerate(xs, 1) if 100 * k >= q * len(xs))
    for least in (30, 200, 1000):
        want = {}
        for i, (lang, source, failed, _, tested) in measured.items():
            pools = [[m[3] for m in measured.values() if not m[2] and test(m)] for test in (lambda m: m[:2] == (lang, source), lambda m: m[0] == lang, lambda m: True)]
            pool = next(p for k, p in enumerate(pools) if len(p) >= least or k == 2)
            s = [sorted(bucket(v[k]) for v in pool) for k in range(4)]
            quart = lambda k: (at(s[k], 25), at(s[k], 75))
            (a, b), (c, d), x, y = quart(0), quart(1), at(s[2], 98), at(s[3], 95)
            ok = a - 3 * (b - a) - 150 <= tested[0] <= b + 3 * (b - a) + 150 and tested[1] <= d + 3 * (d - c) + 1000 and tested[2] <= x + x // 8 + 500 and tested[3] <= y + y // 8 + 500
            want[i] = not failed and ok
        got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, DOCS), least=least).collect()}
        assert got == want
    assert 0 < sum(want.values()) < len(want)


def test_overlapping_licence_detections_against_all_pairs():
    like = licenses.rules()[0]
    rule = lambda p, label: dataclasses.replace(like, priority=p, label=label)
    rnd = random.Random(4)
    for _ in range(300):
        found = []
        for _ in range(rnd.randint(0, 25)):
            a = rnd.randrange(20)
            found.append(licenses.Detection(a, a + rnd.randint(1, 8), rule(rnd.randrange(3), rnd.choice("xyz"))))
        found.sort(key=lambda d: (-d.rule.priority, d.start - d.end, d.start, d.rule.label))
        plain, quick, reach = [], [], licenses.Reach({d.start for d in found})
        for d in found:
            if not any(k.start <= d.start and d.end <= k.end for k in plain):
                plain.append(d)
            if reach.upto(d.start) < d.end:
                quick.append(d)
                reach.add(d.start, d.end)
        assert plain == quick
