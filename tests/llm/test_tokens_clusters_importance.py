"""Operators 11 to 13: against brute force, the library and zlib; nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from pixelquilt.llm import ball_kmeans, importance, pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CLASHING = "in_0 long, text string, `a.b` string, out_0 int, `in_text` string, bucket int, `q``x` int, n_tokens int"
TEXTS = [None, "", " ", "  two", "one  ▁ two\n\tthree ", "The quick brown fox", "日本語のテキスト 🙂 \x00 <0x41></s>", " " * 700 + "x" + " " * 33, "a" * 5000, "membres " * 400, "É ñ\x1c"]


# --- SentencePiece --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_of_a_table_are_those_of_the_library(spark, library):
    rnd = random.Random(3)
    texts = TEXTS + ["".join(rnd.choice(["▁", " ", "ab", "s", "membre", "the", "é", "1", "\n"]) for _ in range(rnd.randint(1, 80))) for _ in range(150)]
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)]
    rows += rows[:6]  # repeated rows
    out = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), MODEL, decoded="shown", digests=True).collect()
    assert len(out) == len(rows)
    for r in out:
        want = library.encode(r["text"] or "", add_eos=True)
        assert r["token_ids"] == want and r["n_tokens"] == len(want)
        assert r["shown"] == library.decode(want)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["shown"].encode()).hexdigest()


def test_pieces_with_columns_of_any_name_and_no_rows(spark):
    df = spark.createDataFrame([(1, "some text", "p", 2, "q", 3, 4, 5)], CLASHING)
    row = pieces.encode(df, MODEL).collect()[0].asDict()
    assert row["a.b"] == "p" and row["q`x"] == 4 and row["n_tokens"] == 3 and row["out_0"] == 2
    assert pieces.encode(df.limit(0), MODEL).collect() == []
    assert pieces.encode(df, MODEL, end=False).collect()[0]["token_ids"] == row["token_ids"][:-1]


def test_long_texts_go_in_pieces(monkeypatch, library):
    text = " ".join(random.Random(4).choice(["over", "größe", "123", "\n", "日本", "x" * 30]) for _ in range(3000))
    monkeypatch.setattr(pieces, "RUN", 257)
    assert pieces.PieceBpe(MODEL).encode_run([text, "", text[:5]])[0].tolist() == library.encode(text)


def test_decoding_any_ids(library):
    coder, rnd = pieces.coder(MODEL), random.Random(5)
    for _ in range(3000):
        ids = [rnd.randrange(32000) if rnd.random() < 0.5 else rnd.randrange(262) for _ in range(rnd.randrange(9))]
        assert coder.decode(ids) == library.decode(ids)


def test_words_of_equal_hash_stay_apart(monkeypatch, library):
    monkeypatch.setattr(pieces, "mix64", lambda x: np.zeros_like(x))
    text = "these words have all one hash " * 3
    assert pieces.PieceBpe(MODEL).encode_run([text])[0].tolist() == library.encode(text)


# --- ball k-means ---------------------------------------------------------------------------------


def plain_kmeans(rows, k, rounds, dims=64, scale=64, seed=1):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in start]
    for r in range(rounds + 1):
        best = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if r < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, b) in zip(kept, best) if b == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    total = sum(d for d, _ in best)
    inertia = [sum(d for d, b in best if b == j) for j in range(len(centroids))]
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], total, shas[j]) for (i, _), (d, j) in zip(kept, best)), key=repr)


def vectors():
    rnd = random.Random(8)
    middle = [[rnd.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + rnd.gauss(0, 0.2) for x in rnd.choice(middle)]) for i in range(240)]
    rows += [(1000 + i, rows[3][1]) for i in range(90)] + [rows[7]] * 3  # one common vector; repeated rows
    rows += [(2000, None), (2001, []), (2002, rows[0][1][:63]), (2003, [None] + rows[0][1][1:]), (2004, [math.nan] + rows[0][1][1:]), (2005, [math.inf] + rows[0][1][1:]), (None, rows[1][1])]
    return rows


@pytest.mark.parametrize("k, rounds", [(16, 3), (3, 5), (1, 1)])
def test_clusters_are_those_of_plain_k_means(spark, k, rounds):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>").repartition(5)
    assert sorted((tuple(r) for r in ball_kmeans.cluster(df, k=k, rounds=rounds).collect()), key=repr) == plain_kmeans(vectors(), k, rounds)


def test_clusters_of_ties_and_of_few_vectors(spark):
    # on a grid of two components most distances tie
    rows = [(i, [float(i % 4), float(i // 4 % 4)]) for i in range(64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for k in (7, 64, 100):
        assert sorted((tuple(r) for r in ball_kmeans.cluster(df, k=k, dims=2, scale=1).collect()), key=repr) == plain_kmeans(rows, k, 3, 2, 1)


def test_clusters_of_nothing_of_huge_components_and_of_clashing_columns(spark):
    schema = "cluster int, `a.b` string, vec_id string, q int, distance int, embedding array<double>"
    none = spark.createDataFrame([(1, "x", "v", 2, 3, [1.0])], schema)
    assert ball_kmeans.cluster(none).collect() == []
    assert ball_kmeans.cluster(none, dims=1).collect()[0]["vec_id"] == "v"
    far = spark.createDataFrame([(1, "x", "v", 2, 3, [1e300]), (1, "x", "w", 2, 3, [-1e300])], schema)
    assert [r["distance"] for r in ball_kmeans.cluster(far, dims=1, k=1, rounds=0).orderBy("distance").collect()] == [0, (2 * ball_kmeans.MOST) ** 2]


def test_balls_compare_with_few_neighbours():
    rnd = np.random.default_rng(1)
    centroids = rnd.integers(-1000, 1000, (40, 8))
    x = (centroids[rnd.integers(0, 40, 4000)] + rnd.integers(-30, 30, (4000, 8))).astype(np.int64)
    own, best = ball_kmeans.Balls(centroids).first(x)
    radius = np.array([np.sqrt(best[own == j].max(initial=0)) for j in range(40)])
    balls = ball_kmeans.Balls(centroids, radius)
    again, same = balls.again(x, own)
    assert (again == own).all() and (same == best).all()
    assert sum(len(n) for _, n in balls.near) < 40 * 39 / 4


# --- importance resampling ------------------------------------------------------------------------


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def grams(t, most):
    w = words(t)
    return [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, most, buckets, percent, least):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, x in docs:
        for g in grams(x, most):
            s[bucket(g)] += 1
    for x in target:
        for g in grams(x, most):
            t[bucket(g)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        own = [gain[bucket(g)] for g in grams(x, most)]
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(own) // len(own) if own else 0
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def corpus():
    rnd = random.Random(9)
    vocab = ["".join(rnd.choice("abcdeABC019éß") for _ in range(rnd.randint(1, 9))) for _ in range(120)]
    body = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocab) for _ in range(n))
    docs = [(i, body(rnd.randint(1, 60))) for i in range(150)] + [(500 + i, "same text of many rows " * 5) for i in range(60)]
    docs += [(900, None), (901, ""), (902, "?! "), (903, "x" * 70_000 + " y " + "ß" * 40_000), (904, body(30_000)), (None, body(40)), (3, docs[3][1]), (3, docs[3][1])]
    return docs, [body(30) for _ in range(9)] + [None, ""]


@pytest.mark.parametrize("most, buckets, percent, least", [(1, 10_000, 10, 20), (3, 700, 37, 2), (2, 50, 100, 0), (4, 10_000, 0, 20)])
def test_resampling_is_that_of_spelled_out_features(spark, most, buckets, percent, least, monkeypatch):
    monkeypatch.setattr(importance, "CHUNK", 5000 if most > 1 else importance.CHUNK)
    docs, target = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance.resample(d, t, most=most, buckets=buckets, percent=percent, least_words=least)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_resample(docs, target, most, buckets, percent, least)


def test_runs_of_words_cross_chunks(monkeypatch):
    monkeypatch.setattr(importance, "CHUNK", 7)
    text = "ab cde f  ghijk lmnopqrst u v w x yz ab"
    data, bounds = np.frombuffer(("zz " + text).encode(), dtype=np.uint8), np.array([0, 3, 3 + len(text)])
    got = sorted((int(b), int(t)) for bucket, of, _ in importance._Texts(3, 1 << 31).features(data, bounds) for b, t in zip(bucket, of))
    assert got == sorted([(zlib.crc32(g.encode()) % (1 << 31), i) for i, x in enumerate(["zz", text]) for g in grams(x, 3)])


def test_crc_algebra():
    rnd = random.Random(2)
    a = [rnd.randbytes(rnd.randrange(60)) for _ in range(300)]
    b = [rnd.randbytes(rnd.choice([0, 1, 7, 64, 1000, 70_001])) for _ in a]
    crc = lambda x: np.array([zlib.crc32(v) for v in x], dtype=np.uint32)
    assert (importance.combine(crc(a), crc(b), np.array(list(map(len, b)))) == crc([x + y for x, y in zip(a, b)])).all()
    data, size = np.frombuffer(b"".join(a), dtype=np.uint8), np.array(list(map(len, a)))
    assert (importance.word_crcs(data, np.cumsum(size) - size, size) == crc(a)).all()


def test_drawn_rows_keep_their_columns_and_empty_tables_stay_empty(spark):
    docs, target = corpus()
    t = spark.createDataFrame([(x,) for x in target], "text string")
    d = spark.createDataFrame([(i, x, "p", i, 1) for i, x in docs], "doc_id long, text string, `a.b` string, rank long, score int")
    drawn = importance.draw(d, t, percent=50)
    assert drawn.columns == d.columns and 0 < drawn.count() < len(docs)
    assert importance.resample(d.limit(0), t).collect() == []
    assert importance.resample(d, t.limit(0)).where("rank is not null").count() > 0
