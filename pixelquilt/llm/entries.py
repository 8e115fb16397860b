"""The registered queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquilt.llm import ball_kmeans, bpe, chats, decontaminate, importance, licenses, line_dedup, lm_score, partenum, pieces, quality_rules, url_filters, warc
from pixelquilt.llm.common import materialize, read_table


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(read_table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"), carry=["doc_id"])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup(docs)
    gone = F.array_join(F.col("gone").cast("array<string>"), ",")
    return out.select("doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"), gone.alias("removed"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), ids=None, digests=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.link(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = licenses.scan(docs, detections=False)
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation; for kept ones the rendering's characters, and a digest of its parts' digests."""
    turns = read_table(spark, sf_dir, "conversations")
    classes = materialize(chats.collapse(turns), "conversations")
    parts = chats.render(turns, classes.where("kept")).select("conv_id", "part", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha"))
    digest = F.sha2(F.array_join(F.expr("transform(sort_array(collect_list(struct(part, sha))), x -> x.sha)"), ""), 256)
    whole = parts.groupBy("conv_id").agg(F.sum("chars").alias("n_chars"), digest.alias("parts_sha256"))
    return classes.join(whole, "conv_id", "left").select("conv_id", "n_turns", "kept", "covered_by", "n_chars", "parts_sha256")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in a page's path is the document it shows, whose labels are the page's."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    shown = pages.select("page_id", F.expr("try_cast(nullif(regexp_extract(url, '/([0-9]+)', 1), '') as bigint)").alias("doc_id")).where("doc_id is not null")
    good = read_table(spark, sf_dir, "labels").select("doc_id", F.expr("quality = 1 and toxic = 0").alias("good"))
    return url_filters.judge(pages, shown.join(good, "doc_id").select("page_id", "good"))


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.cluster(read_table(spark, sf_dir, "embeddings"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=None, digests=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_index": op1_warc_index,
        "op2_quality_rules": op2_quality_rules,
        "op3_line_dedup": op3_line_dedup,
        "op4_decontaminate": op4_decontaminate,
        "op5_bpe": op5_bpe,
        "op6_partenum": op6_partenum,
        "op7_lm_score": op7_lm_score,
        "op8_licenses": op8_licenses,
        "op9_chats": op9_chats,
        "op10_url_filters": op10_url_filters,
        "op11_ball_kmeans": op11_ball_kmeans,
        "op12_sentencepiece": op12_sentencepiece,
        "op13_importance": op13_importance,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_index": OP1_SQL, "op2_quality_rules": OP2_SQL, "op3_line_dedup": OP3_SQL, "op4_decontaminate": OP4_SQL, "op6_partenum": OP6_SQL, "op9_chats": OP9_SQL, "op10_url_filters": _op10_sql(), "op11_ball_kmeans": _op11_sql(), "op13_importance": OP13_SQL}


def _op10_sql() -> str:
    """The template tree level by level, then all pairs of a node's branches and its clusters one by one; four levels, as the pages need."""
    own = [
        r"""u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path, good
  FROM pages LEFT JOIN (
    SELECT page_id AS pid, bool_and(quality = 1 AND toxic = 0) AS good
    FROM pages JOIN labels ON TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT) = doc_id GROUP BY page_id) ON pid = page_id
), r0 AS (SELECT row_number() OVER () AS rid, page_id, host, path, good, string_split(substr(path, 2), '/') AS segs, '' AS t FROM u)"""
    ]
    for i in (1, 2, 3, 4):
        own.append(
            rf"""s{i} AS (SELECT *, segs[{i}] AS seg, CASE WHEN segs[{i}] IS NULL THEN NULL WHEN regexp_matches(segs[{i}], '^[0-9]+$') THEN '<n>'
  WHEN regexp_matches(segs[{i}], '^[0-9]+[.][A-Za-z0-9]+$') THEN '<n.>' WHEN regexp_matches(segs[{i}], '[0-9]') THEN '<mixed>' ELSE '<word>' END AS shape FROM r{i - 1}),
v{i} AS (SELECT host, t FROM s{i} WHERE seg IS NOT NULL AND shape NOT IN ('<n>', '<n.>') GROUP BY host, t
  HAVING count(DISTINCT seg) > 64 OR count(DISTINCT seg) >= 8 AND 4 * count(DISTINCT seg) > count(*)),
r{i} AS MATERIALIZED (SELECT rid, page_id, host, path, good, segs, s.t || CASE WHEN seg IS NULL THEN '' WHEN shape IN ('<n>', '<n.>') OR v.t IS NOT NULL THEN '/' || shape ELSE '/' || seg END AS t
  FROM s{i} s LEFT JOIN v{i} v USING (host, t))"""
        )
    own.append(
        """r AS (SELECT rid, page_id, host, path, good, t AS template FROM r4),
m5 AS (SELECT host, template, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad, string_split(substr(template, 2), '/') AS t FROM r GROUP BY host, template)"""
    )
    for d in (4, 3, 2, 1):
        own.append(
            f"""b{d} AS MATERIALIZED (SELECT *, array_to_string(t[1:{d - 1}], '/') AS prefix, CASE WHEN t[{d}] NOT LIKE '<%' THEN t[{d}] END AS b,
  CASE WHEN len(t) <= {d} THEN chr(1) WHEN t[{d + 1}] LIKE '{{%}}' THEN '{{*}}' ELSE t[{d + 1}] END AS nx FROM m{d + 1}),
g{d} AS (SELECT host, prefix, b, sum(n) AS nb, CASE WHEN sum(good) + sum(bad) = 0 THEN 'none' WHEN sum(good) >= sum(bad) THEN 'good' ELSE 'bad' END AS lean
  FROM b{d} WHERE b IS NOT NULL GROUP BY host, prefix, b),
k{d} AS (SELECT host, prefix, b, lean, nb, nx, CAST(sum(n) AS DOUBLE) AS c, count(*) OVER (PARTITION BY host, prefix, b) AS kinds FROM b{d} JOIN g{d} USING (host, prefix, b) GROUP BY host, prefix, b, lean, nb, nx),
p{d} AS (SELECT x.host, x.prefix, x.b AS early, y.b AS late, x.nb AS m, y.nb AS n, x.kinds + y.kinds - count(*) - 1 AS free,
    sum((y.nb * x.c - x.nb * y.c) ^ 2 / (x.c + y.c)) AS shared, sum(x.c) AS xc, sum(y.c) AS yc, sum(least(x.c / x.nb, y.c / y.nb)) AS common
  FROM k{d} x JOIN k{d} y ON x.host = y.host AND x.prefix = y.prefix AND x.lean = y.lean AND x.nx = y.nx AND (x.nb > y.nb OR x.nb = y.nb AND x.b < y.b) GROUP BY x.host, x.prefix, x.b, y.b, x.nb, y.nb, x.kinds, y.kinds),
q{d} AS (SELECT host, prefix, late AS b, list(early) AS alike FROM p{d}
  WHERE common >= 0.5 - 1e-9 AND (shared + CAST(n AS DOUBLE) ^ 2 * (m - xc) + CAST(m AS DOUBLE) ^ 2 * (n - yc)) / m / n <= free + 3 * sqrt(2 * free) + 0.04 * m * n / (m + n) + 1e-9 GROUP BY ALL),
o{d} AS MATERIALIZED (SELECT host, prefix, b, coalesce(alike, []) AS alike, row_number() OVER (PARTITION BY host, prefix ORDER BY nb DESC, b) AS rk FROM g{d} LEFT JOIN q{d} USING (host, prefix, b)),
z{d} AS (SELECT host, prefix, rk, b, b AS lead, [b] AS leaders FROM o{d} WHERE rk = 1
  UNION ALL SELECT host, prefix, rk, b, coalesce(l, b), CASE WHEN l IS NULL THEN list_append(leaders, b) ELSE leaders END
  FROM (SELECT o.host, o.prefix, o.rk, o.b, z.leaders, list_filter(z.leaders, lambda v: list_contains(o.alike, v))[1] AS l
        FROM z{d} z JOIN o{d} o ON o.host = z.host AND o.prefix = z.prefix AND o.rk = z.rk + 1)),
a{d} AS (SELECT host, prefix, b, lead FROM z{d} QUALIFY count(*) OVER (PARTITION BY host, prefix, lead) > 1),
m{d} AS (SELECT host, template, n, good, bad, CASE WHEN lead IS NOT NULL THEN list_concat(t[1:{d - 1}], ['{{' || lead || '}}'], t[{d + 1}:]) ELSE t END AS t FROM b{d} LEFT JOIN a{d} USING (host, prefix, b))"""
        )
    rule = """CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END"""
    own.append(
        f"""f AS (SELECT *, '/' || array_to_string(t, '/') AS into_ FROM m1),
tot AS (SELECT coalesce(sum(good), 0) AS ag, coalesce(sum(bad), 0) AS ab FROM f),
z AS (SELECT host, into_, CAST(sum(good) AS BIGINT) AS n_good, CAST(sum(bad) AS BIGINT) AS n_bad FROM f GROUP BY ALL),
w AS (SELECT *, (1000 * n_good + 10 * CASE WHEN ag + ab = 0 THEN 1000 ELSE 1000 * ag // (ag + ab) END) // (n_good + n_bad + 10) AS purity FROM z, tot),
j AS (SELECT page_id, host, path, {rule} AS rule, purity, into_, n_good, n_bad FROM r JOIN f USING (host, template) JOIN w USING (host, into_))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR purity < 500 THEN 'block' ELSE 'allow' END AS verdict,
       into_ AS template, n_good, n_bad
FROM j"""
    )
    return "WITH RECURSIVE " + ",\n".join(own)


def _op11_sql() -> str:
    """Three rounds written out; a table of (centroid, component) a round."""
    own = [
        """v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), x AS MATERIALIZED (SELECT rid, unnest(range(1, 65)) AS i, unnest(q) AS a FROM v),
c0 AS (
  SELECT c, unnest(range(1, 65)) AS i, unnest(q) AS b
  FROM (SELECT q, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), q) - 1 AS c FROM v QUALIFY c < 16)
)"""
    ]
    for r in range(4):
        own.append(
            f"""d{r} AS (SELECT rid, c, sum((a - b) * (a - b)) AS dist FROM x JOIN c{r} USING (i) GROUP BY rid, c),
a{r} AS MATERIALIZED (SELECT rid, min((dist, c)) AS best FROM d{r} GROUP BY rid)"""
        )
        if r < 3:
            own.append(
                f"""s{r} AS (SELECT best[2] AS c, i, sum(a) AS s, count(*) AS n FROM x JOIN a{r} USING (rid) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN b ELSE (s - ((s % n) + n) % n) // n END AS b FROM c{r} LEFT JOIN s{r} USING (c, i))"""
            )
    return "WITH " + ",\n".join(own) + """
, h AS (SELECT c, sha256(string_agg(CAST(CAST(b AS BIGINT) AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(best[1] AS BIGINT) AS distance,
       CAST(sum(best[1]) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM v JOIN (SELECT *, best[2] AS c FROM a3) USING (rid) JOIN h USING (c)
"""


OP13_SQL = r"""
WITH RECURSIVE step0 AS (SELECT i AS k, i AS v, 0 AS n FROM range(256) t(i)),
steps AS (
  SELECT k, v, n FROM step0 UNION ALL
  SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n + 1 FROM steps WHERE n < 8
), tab AS (SELECT k, v FROM steps WHERE n = 8),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark
), x AS (SELECT rid, unnest(w) AS word FROM d),
words AS (SELECT word, hex(word) AS h FROM (SELECT word FROM x UNION SELECT word FROM b)),
reg AS (
  SELECT word, h, 1 AS i, CAST(4294967295 AS BIGINT) AS r FROM words UNION ALL
  SELECT word, h, i + 2, xor(v, r >> 8) FROM reg JOIN tab ON k = xor(r & 255, CAST('0x' || substr(h, i, 2) AS BIGINT)) WHERE i < length(h)
), crc AS (SELECT word, xor(r, 4294967295) % 10000 AS bucket FROM reg WHERE i > length(h)),
xs AS (SELECT rid, bucket FROM x JOIN crc USING (word)),
s AS (SELECT bucket, count(*) AS s FROM xs GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM b JOIN crc USING (word) GROUP BY bucket),
tot AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS all_s, (SELECT coalesce(sum(t), 0) FROM t) AS all_t),
g AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(all_s + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(all_t + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), tot
), y AS (SELECT rid, sum(gain) AS total, count(*) AS n FROM xs JOIN g USING (bucket) GROUP BY rid),
z AS (
  SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS BIGINT) AS weight,
         CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN y USING (rid)
), q AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM z),
r AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM q)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM q WHERE n_features >= 20) THEN CAST(place AS BIGINT) END AS rank
FROM r
"""

OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM p),
dw AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT rid, i, p.n, item_id FROM dw JOIN p ON dw.s = p.s AND dw.n = p.n),
hit AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS x FROM hits) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, i - 1 AS line, list_sort(list_distinct(regexp_extract_all(lower(ls[i]), '[^\x20\x09-\x0D]+'))) AS ws
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)
), k AS (SELECT ws, len(ws) AS n, min((doc_id, line)) AS first, row_number() OVER () AS id FROM l WHERE len(ws) >= 1 GROUP BY ws),
w AS (SELECT id, n, first, unnest(ws) AS word FROM k),
f AS (SELECT word, count(*) AS c FROM w GROUP BY word),
o AS (SELECT id, n, first, word, row_number() OVER (PARTITION BY id ORDER BY c, word) AS pos FROM w JOIN f USING (word)),
p AS (SELECT * FROM o WHERE pos <= n - (n * 9 + 9) // 10 + 1),
c AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.word = b.word AND b.first < a.first
  AND least(a.n, b.n) * 10 >= greatest(a.n, b.n) * 9
), s AS (
  SELECT DISTINCT a AS id FROM (
    SELECT a, len(list_intersect(x.ws, y.ws)) AS shared, x.n + y.n AS total FROM c JOIN k x ON x.id = a JOIN k y ON y.id = b)
  WHERE 10 * shared >= 9 * (total - shared)
), g AS (
  SELECT doc_id, line FROM l JOIN k USING (ws) LEFT JOIN s USING (id)
  WHERE (doc_id, line) <> first OR s.id IS NOT NULL
), x AS (SELECT doc_id, list(line ORDER BY line) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       coalesce(array_to_string(gone, ','), '') AS removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT coalesce(list_contains(gone, i - 1), false)), lambda i: ls[i]), chr(10))) AS text_sha256
FROM d LEFT JOIN x USING (doc_id)
"""

OP9_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(role || chr(0) || text ORDER BY turn) AS ts, count(*) AS n FROM t GROUP BY conv_id),
p AS (
  SELECT k, key, max((n, -conv_id)) AS x
  FROM (SELECT conv_id, n, k, array_to_string(ts[1:k], chr(1)) AS key FROM (SELECT *, unnest(range(1, n)) AS k FROM c)) GROUP BY k, key
), e AS (SELECT *, array_to_string(ts, chr(1)) AS key, min(conv_id) OVER (PARTITION BY ts) AS least FROM c),
b AS (
  SELECT e.conv_id, e.n, coalesce(-p.x[2], CASE WHEN least < conv_id THEN least END) AS covered_by
  FROM e LEFT JOIN p ON p.k = e.n AND p.key = e.key
), r AS (
  SELECT conv_id, part, string_agg('<|im_start|>' || role || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS s
  FROM (SELECT *, CAST(floor(turn / 1024) AS BIGINT) AS part FROM t) GROUP BY conv_id, part
), w AS (SELECT conv_id, CAST(sum(length(s)) AS BIGINT) AS n_chars, sha256(string_agg(sha256(s), '' ORDER BY part)) AS parts_sha256 FROM r GROUP BY conv_id)
SELECT b.conv_id, b.n AS n_turns, covered_by IS NULL AS kept, covered_by,
       CASE WHEN covered_by IS NULL THEN n_chars END AS n_chars, CASE WHEN covered_by IS NULL THEN parts_sha256 END AS parts_sha256
FROM b JOIN w USING (conv_id)
"""

OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) c USING (doc_id)
"""

OP1_SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h,
         lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)) AS host
  FROM pages
), q AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS top,
         array_to_string(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1, 1)), '') AS d
  FROM p
)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to,
       CASE WHEN instr(coalesce(url, ''), '://') > 0
            THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ')' ||
                 lower(regexp_replace(regexp_extract(url, '://[^/?#]*([^#]*)', 1), '/$', ''))
            ELSE '' END AS url_key,
       strftime(make_timestamp((1704067200 + page_id % 31536000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM q
"""

OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT x) AS n FROM (SELECT rid, unnest(range(i, i + 3)) AS x FROM twice) GROUP BY rid),
base AS (
  SELECT rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid)
), lines AS (SELECT rid, line, count(*) AS times FROM (SELECT rid, unnest(l) AS line FROM d) GROUP BY rid, line HAVING count(*) = 2),
echo AS (SELECT rid, any_value(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS echo_words FROM lines GROUP BY rid),
m AS (
  SELECT base.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         word_chars * 100 // greatest(n_words, 1) AS word_length, n_symbols * 10000 // greatest(n_words, 1) AS symbol_rate,
         n_dup_lines * 10000 // greatest(n_lines, 1) AS dup_line_rate, n_repeat_words * 10000 // greatest(n_words, 1) AS repeat_rate,
         CASE WHEN n_dup_lines = 1 THEN 0 ELSE n_dup_lines * 10000 // greatest(n_lines, 1) END AS dup_tested,
         greatest(n_repeat_words - greatest(2 * CASE WHEN n_dup_lines = 1 THEN coalesce(echo_words, 0) ELSE 0 END, 6), 0) * 10000 // greatest(n_words, 1) AS repeat_tested
  FROM base LEFT JOIN echo USING (rid)
), v AS (
  SELECT lang, source, unnest(['word_length', 'symbol_rate', 'dup_line_rate', 'repeat_rate']) AS metric, unnest([word_length, symbol_rate, dup_line_rate, repeat_rate]) AS v
  FROM m WHERE NOT base_failed
), k AS (SELECT lang, source, metric, CASE WHEN v < 64 THEN v ELSE v - v % CAST(pow(2, floor(log2(v)) - 5) AS BIGINT) END AS bucket FROM v),
lv AS (
  SELECT 2 AS level, lang, source, metric, bucket, count(*) AS n FROM k GROUP BY ALL UNION ALL
  SELECT 1, lang, NULL, metric, bucket, count(*) FROM k GROUP BY ALL UNION ALL SELECT 0, NULL, NULL, metric, bucket, count(*) FROM k GROUP BY ALL
), cu AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, metric) AS docs FROM lv),
q AS (
  SELECT level, lang, source, metric, any_value(docs) AS docs, min(bucket) FILTER (100 * upto >= 25 * docs) AS q25, min(bucket) FILTER (100 * upto >= 75 * docs) AS q75,
         min(bucket) FILTER (100 * upto >= 98 * docs) AS q98, min(bucket) FILTER (100 * upto >= 95 * docs) AS q95
  FROM cu GROUP BY level, lang, source, metric
), lim AS (
  SELECT keys.lang, keys.source, metric, q25, q75, q98, q95
  FROM (SELECT DISTINCT lang, source FROM m) keys JOIN q ON level = 0 OR docs >= 200 AND q.lang = keys.lang AND (level = 1 OR q.source = keys.source)
  QUALIFY row_number() OVER (PARTITION BY keys.lang, keys.source, metric ORDER BY level DESC) = 1
), wide AS (
  SELECT lang, source,
         max(q75 + 3 * (q75 - q25) + 150) FILTER (metric = 'word_length') AS wl_hi,
         max(q25 - 3 * (q75 - q25) - 150) FILTER (metric = 'word_length') AS wl_lo,
         max(q75 + 3 * (q75 - q25) + 1000) FILTER (metric = 'symbol_rate') AS sy_hi,
         max(q98 + q98 // 8 + 500) FILTER (metric = 'dup_line_rate') AS du_hi,
         max(q95 + q95 // 8 + 500) FILTER (metric = 'repeat_rate') AS re_hi
  FROM lim GROUP BY lang, source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(word_length BETWEEN wl_lo AND wl_hi AND symbol_rate <= sy_hi AND dup_tested <= du_hi AND repeat_tested <= re_hi, true) AS kept
FROM m LEFT JOIN wide USING (lang, source)
"""
