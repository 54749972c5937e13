"""Operator 7, URL filters: allow and block rules, and path-template trees that learn from them for the rest.

A tree of path templates is built for each host, for each domain (the last two names of a host) and for all hosts. Segments
are generalised by their shape, then by the tree: rare segments, and branches that are statistically like their node,
become one wildcard. A template's purity is its share of blocked pages among labelled ones, smoothed by that of the page's
template in the domain's tree, which is smoothed by the one of all hosts: where a host says nothing, its domain does.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The rules of the query.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DEPTH = 8  # levels of the tree, or as many as labelled paths have; what lies deeper, all without labels, is one segment
LEAST, PART = 4, 0.02  # pages, and share of its node's pages, that a branch without labels must have to stay by itself
ALIKE = 1.96  # standard errors within which a branch is like its node: in its share of blocked pages, of distinct templates
PRIOR, SMOOTHING, REJECT = 0.5, 4.0, 0.8  # smoothed purity: (blocked + 4 * that of the scope above) / (labelled + 4)
SCOPES = ("host", "domain", "all")


def parsed(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first :// up to /, ? , # or the end, A-Z lower-cased; then up to ?, # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does; block goes before allow of the same length."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """A path's segments with numbers, long hex strings and numbers before an extension generalised by their shape."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(r"^[0-9]+$"), "{n}").when(s.rlike(r"^[0-9a-fA-F-]{16,}$"), "{id}").when(s.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), F.regexp_replace(s, r"^[0-9]+", "{n}")).otherwise(s))


def scopes(host: Column) -> Column:
    """(kind, scope) of the trees that a host belongs to."""
    domain = F.regexp_extract(host, r"([^.]*\.[^.]*)\z", 1)
    names = (host, F.when(domain == "", host).otherwise(domain), F.lit(""))
    return F.array(*[F.struct(F.lit(k).alias("kind"), n.alias("scope")) for k, n in enumerate(names)])


def templates(counts: DataFrame) -> DataFrame:
    """(kind, scope, raw, template, blocked, labelled): of each raw template (segments) of a scope the tree's template and
    the labels of all that share it.

    ``counts``: kind, scope, raw, n, blocked, allowed. Level by level a branch becomes part of its node's wildcard, unless
    it is the only one; or it has labels, and its share of blocked pages isn't the node's; or it has no labels and is
    frequent; or it is frequent and has its pages on more or fewer distinct templates than the node. Each level is two
    aggregations with map-side sums over templates (not pages) and two joins; no scope's pages are gathered.
    """
    tree = counts.withColumn("path", F.array().cast("array<string>"))
    deepest, marked = counts.agg(F.max(F.size("raw")), F.max(F.when(F.col("blocked") + F.col("allowed") > 0, F.size("raw")))).first()
    depth = min(deepest or 0, max(DEPTH, marked or 0))
    node = ["kind", "scope", "path"]
    for level in range(1, depth + 1):
        tree = tree.withColumn("seg", F.expr(f"CASE WHEN size(raw) >= {level} THEN raw[{level - 1}] END"))
        kids = tree.where("seg IS NOT NULL").groupBy(*node, "seg").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"), F.sum("n").alias("n"), F.count("*").alias("t"))
        nodes = kids.groupBy(*node).agg(F.count("*").alias("kids"), F.sum("b").alias("nb"), F.sum("a").alias("na"), F.sum("n").alias("nn"), F.sum("t").alias("nt"))
        kept = kids.join(nodes, node).select(*node, "seg", F.when(F.expr(OWN), F.col("seg")).otherwise("*").alias("as"))
        tree = tree.join(kept, [*node, "seg"], "left").withColumn("path", F.when(F.col("as").isNotNull(), F.concat("path", F.array("as"))).otherwise(F.col("path"))).drop("as", "seg")
        tree = common.stored(tree, "tree")
    tree = tree.withColumn("path", F.when(F.size("raw") > depth, F.concat("path", F.array(F.lit("{**}")))).otherwise(F.col("path")))
    sums = tree.groupBy(*node).agg(F.sum("blocked").alias("blocked"), (F.sum("blocked") + F.sum("allowed")).alias("labelled"))
    return tree.drop("blocked", "allowed").join(sums, node).select("kind", "scope", "raw", F.concat(F.lit("/"), F.array_join("path", "/")).alias("template"), "blocked", "labelled")


def _own() -> str:
    """SQL of whether a branch (b blocked, a allowed, n pages, t templates) of a node (nb, na, nn, nt, kids) stays by itself."""
    share, shape = f"((nb + {SMOOTHING * PRIOR}D) / (nb + na + {SMOOTHING}D))", "(nt / nn)"
    far = f"abs(b - (b + a) * {share}) > {ALIKE}D * sqrt((b + a) * {share} * (1 - {share}))"
    odd = f"abs(t - n * {shape}) > {ALIKE}D * sqrt(n * {shape} * (1 - {shape}) + 1e-9D)"
    frequent = f"(n >= {LEAST} AND n >= {PART}D * nn)"
    return f"kids = 1 OR (b + a > 0 AND {far}) OR (b + a = 0 AND {frequent}) OR ({frequent} AND {odd})"


OWN = _own()


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity, evidence.

    The rules' verdicts are the tree's labels; pages that no rule fits are blocked if their template's smoothed share
    of blocked pages is REJECT or more. ``evidence`` is the narrowest scope whose template has labels (host, domain, all),
    none if no scope's has: then the purity is PRIOR, so the page is allowed. A null url, or one without ://, has
    an empty host and path; those are a host like any other. Repeated rows count as often as they occur; other columns
    (html) are not read.
    """
    urls = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("__url"))
    host, path = parsed(F.col("__url"))
    urls = urls.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    urls = common.stored(urls.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("given"), segments(F.col("path")).alias("raw")), "urls")
    counts = urls.groupBy("host", "raw").agg(F.count("*").alias("n"), F.count_if(F.col("given") == "block").alias("blocked"), F.count_if(F.col("given") == "allow").alias("allowed"))
    counts = common.stored(counts, "counts")
    wide = counts.select(F.inline(scopes(F.col("host"))), "raw", "n", "blocked", "allowed")
    wide = wide.groupBy("kind", "scope", "raw").agg(*[F.sum(c).alias(c) for c in ("n", "blocked", "allowed")])
    of = common.stored(templates(common.stored(wide, "scopes")), "templates")
    each = counts.select("host", "raw", *[scopes(F.col("host"))[k]["scope"].alias(name) for k, name in enumerate(SCOPES)][1:])
    purity, evidence = F.lit(PRIOR), F.lit("none")
    for k, name in reversed(list(enumerate(SCOPES))):
        mine = of.where(F.col("kind") == k).select(F.col("scope").alias(name), "raw", F.col("template").alias(f"t_{name}"), F.col("blocked").alias(f"b_{name}"), F.col("labelled").alias(f"l_{name}"))
        each = each.join(mine, [name, "raw"])
        purity = (F.col(f"b_{name}") + SMOOTHING * purity) / (F.col(f"l_{name}") + SMOOTHING)
        evidence = F.when(F.col(f"l_{name}") > 0, name).otherwise(evidence)
    each = common.stored(each.select("host", "raw", F.col("t_host").alias("template"), purity.alias("purity"), evidence.alias("evidence")), "judged")
    learned = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return urls.join(each, ["host", "raw"]).select("page_id", "host", "path", "rule", F.coalesce("given", learned).alias("verdict"), "template", "purity", "evidence")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql(rules=RULES, depth: int = DEPTH) -> str:
    """The same in one statement, a level of the trees after the other; paths of labelled pages must not be deeper."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
    fits = lambda text: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')".format(text[: text.index("/")], text[text.index("/") :])
    rule, given = ("CASE " + " ".join(f"WHEN {fits(t)} THEN '{v(k, t)}'" for k, t in ordered) + " END" for v in (lambda k, t: t, lambda k, t: k))
    shape = r"CASE WHEN regexp_full_match(s, '[0-9]+') THEN '{n}' WHEN regexp_full_match(s, '[0-9a-fA-F-]{16,}') THEN '{id}' WHEN regexp_full_match(s, '[0-9]+\.[A-Za-z0-9]+') THEN regexp_replace(s, '^[0-9]+', '{n}') ELSE s END"
    own = re.sub(r"([0-9.e-]+)D\b", r"\1::DOUBLE", OWN)
    out = rf"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
g AS (SELECT *, {rule} AS rule, {given} AS given, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {shape}) AS raw FROM h),
c AS (SELECT host, raw, count(*) AS n, count(*) FILTER (given = 'block') AS b, count(*) FILTER (given = 'allow') AS a FROM g GROUP BY ALL),
w AS (SELECT *, host AS s0, CASE WHEN regexp_extract(host, '[^.]*\.[^.]*$') = '' THEN host ELSE regexp_extract(host, '[^.]*\.[^.]*$') END AS s1, '' AS s2 FROM c),
t0 AS (SELECT kind, scope, raw, sum(n) AS n, sum(b) AS b, sum(a) AS a, CAST([] AS VARCHAR[]) AS path FROM ({" UNION ALL ".join(f"SELECT {k} AS kind, s{k} AS scope, raw, n, b, a FROM w" for k in range(3))}) GROUP BY kind, scope, raw)"""
    for k in range(1, depth + 1):
        out += f""",
k{k} AS (SELECT kind, scope, path, raw[{k}] AS seg, sum(b) AS b, sum(a) AS a, sum(n) AS n, count(*) AS t FROM t{k - 1} WHERE len(raw) >= {k} GROUP BY ALL),
o{k} AS (SELECT kind, scope, path, seg, CASE WHEN {own} THEN seg ELSE '*' END AS put FROM (SELECT *, count(*) OVER p AS kids, sum(b) OVER p AS nb, sum(a) OVER p AS na, sum(n) OVER p AS nn, sum(t) OVER p AS nt FROM k{k} WINDOW p AS (PARTITION BY kind, scope, path))),
t{k} AS (SELECT t.kind, t.scope, t.raw, t.n, t.b, t.a, CASE WHEN o.put IS NULL THEN t.path ELSE list_append(t.path, o.put) END AS path FROM t{k - 1} t LEFT JOIN o{k} o ON t.kind = o.kind AND t.scope = o.scope AND t.path = o.path AND o.seg = CASE WHEN len(t.raw) >= {k} THEN t.raw[{k}] END)"""
    out += f""",
f AS (SELECT kind, scope, raw, b, a, CASE WHEN len(raw) > {depth} THEN list_append(path, '{{**}}') ELSE path END AS path FROM t{depth}),
s AS (SELECT kind, scope, raw, path, sum(b) OVER p AS b, sum(a + b) OVER p AS l FROM f WINDOW p AS (PARTITION BY kind, scope, path)),
e AS (SELECT host, w.raw, '/' || array_to_string(x.path, '/') AS template, (z.b + {SMOOTHING * PRIOR}::DOUBLE) / (z.l + {SMOOTHING}::DOUBLE) AS p2, y.b AS b1, y.l AS l1, x.b AS b0, x.l AS l0, z.l AS l2
  FROM w JOIN s x ON x.kind = 0 AND x.scope = s0 AND x.raw = w.raw JOIN s y ON y.kind = 1 AND y.scope = s1 AND y.raw = w.raw JOIN s z ON z.kind = 2 AND z.raw = w.raw),
q AS (SELECT *, (b0 + {SMOOTHING}::DOUBLE * ((b1 + {SMOOTHING}::DOUBLE * p2) / (l1 + {SMOOTHING}::DOUBLE))) / (l0 + {SMOOTHING}::DOUBLE) AS purity FROM e)
SELECT page_id, g.host, g.path, rule, coalesce(given, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template, purity, CASE WHEN l0 > 0 THEN 'host' WHEN l1 > 0 THEN 'domain' WHEN l2 > 0 THEN 'all' ELSE 'none' END AS evidence FROM g JOIN q ON g.host = q.host AND g.raw = q.raw"""
    return out


SQL = _sql()
