"""URL filters: listed rules first, then the purity of a URL's path template.

Per host, paths form a tree of segments, as deep as the longest path.  Number segments, and all segments of a node that has
too many different ones, become wildcards.  Then, deepest nodes first, the branches of a node are
clustered: from the largest to the smallest, each joins the first cluster whose leader has labels
that lean the same way and next segments that a two-sample test can't tell from its own, or leads
a new one.  A cluster of several is named after its leader, ``{leader}``.  A template's purity is
its share of good labels, smoothed with the share of all labels; below ``LEAST_PURITY`` its URLs
are blocked.

Everything is joins and sums by (host, template): a host that has a third of all URLs is summed
up before each shuffle, and only the skewed joins of rows with their tree nodes see it, which
Spark splits.  A node has at most ``MANY`` named branches, and a branch about as many different
next segments, as more would have made them wildcards: the clustering of a node, one expression
over its counts, is bounded whatever the number of its URLs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquilt.llm.common import lower_ascii, materialize, quoted

#: A node with MANY different segments, or with SOME that hold more than a quarter of its URLs, is variable.
MANY, SOME = 64, 8
#: The divergence that two branches may have besides sampling error (0.04: half and half against 0.6 and 0.4), and the
#: least share of their next segments that must be common, so that a few URLs that have nothing in common don't pass.
EFFECT, COMMON = 0.04, 0.5
#: Weight of the prior in labels, and the purity below which a template is rejected, in per mille.
PRIOR_WEIGHT, LEAST_PURITY = 10, 500


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(urls: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``rule`` and ``ruled`` (its verdict) of the longest rule that fits host and path, else null."""
    rule = ruled = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = (F.col("host") == r.host) | F.col("host").endswith("." + r.host)
        fits &= F.col("path").startswith(r.path)
        rule = F.when(fits, r.name) if rule is None else rule.when(fits, r.name)
        ruled = F.when(fits, r.verdict) if ruled is None else ruled.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return urls.withColumn("rule", none if rule is None else rule).withColumn("ruled", none if ruled is None else ruled)


def _shape(s: str) -> str:
    return f"case when {s} rlike '^[0-9]+$' then '<n>' when {s} rlike '^[0-9]+[.][A-Za-z0-9]+$' then '<n.>' when {s} rlike '[0-9]' then '<mixed>' else '<word>' end"


def _part(s: str) -> str:
    return f"case when {_shape(s)} in ('<n>', '<n.>') then concat('/', {_shape(s)}) else concat('/', {s}) end"


def templates(paths: DataFrame) -> DataFrame:
    """(columns, template): ``paths`` has host, path and n, a row each; segments are generalised level by level.

    A node of fewer than SOME paths has no variable one below, so their rest needs no more
    levels; the others go on until none is left.
    """
    rows = paths.withColumn("segs", F.split(F.expr("substring(path, 2)"), "/")).withColumn("t", F.lit(""))
    ended, i = [], 0
    while True:
        i += 1
        seg = f"get(segs, {i - 1})"
        rows = rows.withColumn("seg", F.expr(seg)).withColumn("shape", F.expr(_shape("seg")))
        rows = rows.withColumn("name", F.expr("case when shape not in ('<n>', '<n.>') then seg end"))
        each = rows.groupBy("host", "t", "name").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("p"))
        nodes = each.groupBy("host", "t").agg(F.sum(F.expr("case when name is not null then c end")).alias("c"), F.count("name").alias("v"), F.sum("p").alias("p"))
        nodes = nodes.select("host", "t", F.expr(f"v > {MANY} or v >= {SOME} and 4 * v > c").alias("variable"), F.expr(f"p < {SOME}").alias("few"))
        rows = rows.join(nodes, ["host", "t"])
        part = F.expr("case when name is null or variable then concat('/', shape) else concat('/', seg) end")
        rest = F.expr(f"case when few then array_join(transform(slice(segs, {i + 1}, size(segs)), s -> {_part('s')}), '') else '' end")
        rows = rows.withColumn("t", F.concat("t", part, rest)).withColumn("over", F.expr(f"few or size(segs) <= {i}"))
        rows = materialize(rows.drop("variable", "few", "seg", "shape", "name"), "url-level")
        ended.append(rows.where("over").drop("over", "segs").withColumnRenamed("t", "template"))
        rows = rows.where("not over").drop("over")
        if rows.isEmpty():
            break
    return reduce(DataFrame.union, ended)


def _branching(stats: DataFrame) -> list[int]:
    """The levels, deepest first, at which a node has more than one branch; numbers up to the depth."""
    named = stats.withColumn("t", F.split(F.expr("substring(template, 2)"), "/")).select("host", "t", F.posexplode("t").alias("at", "b")).where("b not like '<%'")
    node = named.groupBy("at", "host", F.expr("xxhash64(slice(t, 1, at))").alias("prefix")).agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    return sorted((r.at + 1 for r in node.where("lo < hi").select("at").distinct().collect()), reverse=True)


#: A branch (b, lean, n URLs) with its URLs by next segment; ``lead`` names its cluster.
_BRANCH = "struct<b: string, lead: string, lean: string, n: bigint, nexts: map<string, bigint>>"


def _same_law(x: str, y: str) -> str:
    """The two-sample chi-square test of the next segments of branches x and y, and their common share."""
    a, b = f"coalesce(try_element_at({x}.nexts, k), 0)", f"coalesce(try_element_at({y}.nexts, k), 0)"
    keys = f"array_union(map_keys({x}.nexts), map_keys({y}.nexts))"
    over = lambda term: f"aggregate({keys}, cast(0 as double), (s, k) -> s + {term})"
    free = f"(size({keys}) - 1)"
    apart = over(f"pow({y}.n * cast({a} as double) - {x}.n * cast({b} as double), 2) / ({a} + {b})") + f" / {x}.n / {y}.n"
    most = f"{free} + 3 * sqrt(2 * {free}) + {EFFECT} * {x}.n * cast({y}.n as double) / ({x}.n + {y}.n)"
    common = over(f"least({a} / cast({x}.n as double), {b} / cast({y}.n as double))")
    return f"({apart} <= {most} + 1e-9 and {common} >= {COMMON} - 1e-9)"


def _clusters(leaves: DataFrame) -> DataFrame:
    """(host, prefix, b, lead) of the branches that share a cluster; leaves: (host, prefix, b, next, nc, g, k)."""
    node = ["host", "prefix"]
    nexts = F.map_from_entries(F.sort_array(F.collect_list(F.struct("next", "nc"))))
    branches = leaves.groupBy(*node, "b").agg(F.sum("nc").alias("n"), F.sum("g").alias("g"), F.sum("k").alias("k"), nexts.alias("nexts"))
    lean = F.expr("case when g + k = 0 then 'none' when g >= k then 'good' else 'bad' end")
    branches = branches.select(*node, F.struct("b", F.col("b").alias("lead"), lean.alias("lean"), "n", "nexts").cast(_BRANCH).alias("x"))
    nodes = branches.groupBy(*node).agg(F.collect_list("x").alias("xs")).where("size(xs) > 1")
    first = "case when l.n <> r.n then if(l.n > r.n, -1, 1) when l.b < r.b then -1 else 1 end"
    leader = f"get(filter(done, y -> y.b = y.lead and y.lean = x.lean and {_same_law('y', 'x')}), 0).b"
    led = f"named_struct('b', x.b, 'lead', coalesce({leader}, x.b), 'lean', x.lean, 'n', x.n, 'nexts', x.nexts)"
    grown = f"cast(concat(done, array({led})) as array<{_BRANCH}>)"
    nodes = nodes.withColumn("xs", F.expr(f"aggregate(array_sort(xs, (l, r) -> {first}), cast(array() as array<{_BRANCH}>), (done, x) -> {grown})"))
    members = nodes.select(*node, F.explode(F.expr("filter(xs, x -> size(filter(xs, y -> y.lead = x.lead)) > 1)")).alias("x"))
    return members.select(*node, "x.b", "x.lead")


def merged(stats: DataFrame) -> DataFrame:
    """(host, template, into, n, good, bad): stats (host, template, n, good, bad) with similar branches merged."""
    rows = stats.withColumn("t", F.split(F.expr("substring(template, 2)"), "/"))
    for d in _branching(stats):
        seg = f"get(t, {d - 1})"
        rows = rows.withColumn("prefix", F.expr(f"array_join(slice(t, 1, {d - 1}), '/')")).withColumn("b", F.expr(f"case when {seg} not like '<%' then {seg} end"))
        #: Segments below are clusters already, named after other leaders under each branch: all count as one here.
        rows = materialize(rows.withColumn("next", F.expr(f"case when size(t) <= {d} then chr(1) when get(t, {d}) like '{{%}}' then '{{*}}' else get(t, {d}) end")), "url-branches")
        leaves = rows.where("b is not null").groupBy("host", "prefix", "b", "next").agg(F.sum("n").alias("nc"), F.sum("good").alias("g"), F.sum("bad").alias("k"))
        rows = rows.join(_clusters(leaves), ["host", "prefix", "b"], "left")
        rows = rows.withColumn("t", F.expr(f"case when lead is not null then transform(t, (x, i) -> if(i = {d - 1}, concat('{{', lead, '}}'), x)) else t end")).drop("lead", "prefix", "b", "next")
    return rows.select("host", "template", F.concat(F.lit("/"), F.array_join("t", "/")).alias("into"), "n", "good", "bad")


def judge(pages: DataFrame, labels: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, n_good, n_bad) for every row of ``pages``.

    labels: (page_id, good boolean), a row for each labelled page; of several, one bad label
    makes a page bad; null labels and ids are left out.  A null url, or one without ``://``, has
    empty host and path and the template '/'.  Templates without labels have the prior's purity.
    A path may have any length; branches of equal size are taken by name.  Repeated rows count each; further columns are left out; an empty table gives an empty one.
    """
    rows = pages.select(F.col(quoted(page_id)).alias("page_id"), host_of(F.col(quoted(url))).alias("host"), path_of(F.col(quoted(url))).alias("path"))
    if labels is None:
        rows = rows.withColumn("good", F.lit(None).cast("boolean"))
    else:
        own = labels.where("page_id is not null and good is not null").groupBy("page_id").agg(F.min("good").alias("good"))
        rows = rows.join(own, "page_id", "left")
    rows = materialize(rows, "url-rows")
    count = lambda c: F.count(F.when(c, 1))
    paths = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), count(F.col("good")).alias("good"), count(~F.col("good")).alias("bad"))
    paths = templates(paths)
    stats = paths.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")])
    tree = materialize(merged(materialize(stats, "url-stats")), "url-tree")
    total = tree.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("all_good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("all_bad"))
    sums = tree.groupBy("host", "into").agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"))
    #: The prior is one row.
    sums = sums.join(F.broadcast(total), F.lit(True)).withColumn("prior", F.expr("case when all_good + all_bad = 0 then 1000 else 1000 * all_good div (all_good + all_bad) end"))
    sums = sums.withColumn("purity", F.expr(f"(1000 * n_good + {PRIOR_WEIGHT} * prior) div (n_good + n_bad + {PRIOR_WEIGHT})"))
    named = tree.select("host", "template", "into").join(sums, ["host", "into"]).select("host", "template", "into", "n_good", "n_bad", "purity")
    named = paths.select("host", "path", "template").join(named, ["host", "template"]).drop("template")
    out = with_rule(rows, rules).join(named, ["host", "path"], "left")
    verdict = F.coalesce("ruled", F.when(F.col("purity") < LEAST_PURITY, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("into").alias("template"), "n_good", "n_bad")
