"""Operator 2, secret scans [native]: fixed patterns, and a randomness test battery under false-discovery control.

Everything is DataFrame and SQL functions. Base spans come from three patterns. The battery adds spans of tokens that
no pattern names but that look drawn at random from an encoding's alphabet:

1. Candidates are runs of 16 or more characters of the base64 alphabets with two of: small letters, capitals, digits.
2. The encoding is inferred from the characters: hex (k = 16), one case and digits (36), letters (52), base64 (64).
3. Three statistics: chi-squared of the k counts against uniformity, runs of character classes, lag-1 serial correlation.
4. Each gives two p-values. One is that of a uniformly random token, two-sided: the least of the three, times three, must
   reach 0.001. The other is that of a written token, one-sided towards randomness; what written tokens are like is
   learned from the corpus, from all its runs of 6 to 15 characters with two classes (``learned``).
5. The three p-values of a written token are combined by the Cauchy combination test, which needs no independence. All
   candidates of all documents go through one Benjamini-Hochberg step at 1 %, with weights in proportion to length.
   Its cut is found on a histogram of 1/16 powers of two, so nothing is sorted or gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The base patterns, in the order in which kinds are listed. The second is the matched group that must
#: have so many characters.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 or more: no part of a failing match can be a match
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"  # [0-9a-f]+ of 24 or more, likewise
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
#: the first class of characters ends before the run does
TWO = r"(?<![A-Za-z0-9+/_-])(?=[a-z+/_-]+[A-Z0-9]|[A-Z+/_-]+[a-z0-9]|[0-9+/_-]+[A-Za-z])"
CANDIDATE = TWO + r"[A-Za-z0-9+/_-]{16,}+={0,2}"
WRITTEN = TWO + r"[A-Za-z0-9+/_-]{6,15}(?![A-Za-z0-9+/_-])"
FALSE_DISCOVERIES, CONSISTENT = 0.01, 0.001
STEPS, DEEPEST = 16, 60  # of the histogram: a power of two is cut into so many, down to 2 ** -60
SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-"
ALPHABETS = {16: "0123456789abcdef", 36: "0123456789abcdefghijklmnopqrstuvwxyz", 52: SYMBOLS[10:62], 64: SYMBOLS}
#: what is taken as seen before the corpus: one turn in eight places, each symbol once
PRIOR_TURNS, PRIOR_PLACES, POOLED = 20, 160, 200
FLOOR = 1e-15

SPAN = "array<struct<start:bigint,stop:bigint,rank:int,kind:string,token:string,part:int>>"


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """SQL of the spans of a pattern's matches in ``text``. Pieces between matches and matches alternate, so their
    lengths (in code points) give the places. Sums run within blocks of 64 matches and over blocks, so that a
    text of very many matches doesn't copy all spans for each."""
    p = "r'" + pattern.replace("'", r"\x27") + "'"
    parts = f"regexp_extract_all(text, {p}, {group})"
    hits = f"zip_with(regexp_extract_all(text, {p}, 0), {parts}, (h, g) -> named_struct('hit', h, 'part', g))"
    pieces = f"filter(zip_with(split(text, {p}, -1), {hits}, (g, h) -> named_struct('gap', length(g), 'hit', h.hit, 'part', h.part)), x -> x.hit IS NOT NULL)"
    block = "slice(w.x, 64 * int(b) + 1, 64)"
    sums = f"transform(sequence(0, (size(w.x) - 1) div 64), b -> aggregate({block}, 0L, (a, x) -> a + x.gap + length(x.hit)))"
    before = f"aggregate({sums}, named_struct('at', 0L, 'out', CAST(array() AS array<bigint>)), (a, s) -> named_struct('at', a.at + s, 'out', concat(a.out, array(a.at))), a -> a.out)"
    none = f"CAST(array() AS {SPAN})"
    span = f"named_struct('start', a.at + x.gap, 'stop', a.at + x.gap + length(x.hit), 'rank', {rank}, 'kind', '{kind}', 'token', x.hit, 'part', length(x.part))"
    walk = f"(a, x) -> named_struct('at', a.at + x.gap + length(x.hit), 'out', concat(a.out, array({span})))"
    whole = f"flatten(transform(v.at, (s, b) -> aggregate(slice(v.x, 64 * b + 1, 64), named_struct('at', s, 'out', {none}), {walk}, a -> a.out)))"
    bound = f"transform(transform(array(named_struct('x', {pieces})), w -> named_struct('x', w.x, 'at', {before})), v -> {whole})[0]"
    return f"CASE WHEN text RLIKE {p} THEN filter({bound}, s -> s.part >= {least}) ELSE {none} END"


def _lower_tail(z: str) -> str:
    """Normal distribution function (logistic approximation; monotonic, fine to about z = -8)."""
    return f"(1 / (1 + exp(least(700D, -(1.5976 * ({z}) + 0.07056 * pow({z}, 3))))))"


def _stepped(tokens: str, steps: list[tuple[str, str]], out: str) -> str:
    """SQL of tokens x by steps: each makes structs with one field more, so that no expression is written out twice."""
    sql, fields = f"transform({tokens}, x -> named_struct('x', x))", ["x"]
    for name, step in steps:
        kept = ", ".join(f"'{f}', s.{f}" for f in fields)
        sql = f"transform({sql}, s -> named_struct({kept}, '{name}', {step}))"
        fields.append(name)
    return f"transform({sql}, s -> {out})"


def _statistics(token: str) -> list[tuple[str, str]]:
    return [
        ("t", f"trim(TRAILING '=' FROM {token})"),
        ("n", "double(length(s.t))"),
        ("k", "CASE WHEN s.t RLIKE '^([0-9a-f]+|[0-9A-F]+)$' THEN 16 WHEN s.t RLIKE '^([0-9a-z]+|[0-9A-Z]+)$' THEN 36 WHEN s.t RLIKE '^[A-Za-z]+$' THEN 52 ELSE 64 END"),
        ("classes", "regexp_replace(regexp_replace(regexp_replace(s.t, '[a-z]', 'a'), '[A-Z]', 'b'), '[0-9]', '0')"),
        ("changes", r"regexp_count(s.classes, r'(.)\1*') - 1D"),
        # of written tokens: a capital belongs to the small letters after it
        ("turns", r"regexp_count(regexp_replace(regexp_replace(regexp_replace(s.t, '[A-Z]?[a-z]+', 'a'), '[A-Z]', 'b'), '[0-9]', '0'), r'(.)\1*') - 1D"),
        ("codes", f"transform(split(s.t, ''), c -> double(instr('{SYMBOLS}', c)))"),
        ("mean", "aggregate(s.codes, 0D, (a, c) -> a + c) / s.n"),
        ("spread", "aggregate(s.codes, 0D, (a, c) -> a + pow(c - s.mean, 2))"),
        ("cross", "aggregate(zip_with(slice(s.codes, 1, size(s.codes) - 1), slice(s.codes, 2, size(s.codes) - 1), (a, b) -> (a - s.mean) * (b - s.mean)), 0D, (a, c) -> a + c)"),
    ]


@dataclass(frozen=True)
class Written:
    """What written tokens are like: by alphabet size the excess of repeated symbols (sum of squared shares * k - 1) and the
    turns from a class to another, a capital and the small letters after it being one, for each place between two
    characters; and the lag-1 serial correlation."""

    excess: dict[int, float]
    turns: dict[int, float]
    serial: float


def learned(docs: DataFrame) -> Written:
    """Sums over all written tokens of the corpus: one pass, one row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    tokens = docs.select(text).select(F.expr(f"CASE WHEN text RLIKE r'{WRITTEN}' THEN regexp_extract_all(text, r'{WRITTEN}', 0) ELSE CAST(array() AS array<string>) END").alias("t"))
    each = tokens.select("t", F.expr(_stepped("t", _statistics("s.x"), "named_struct('k', s.k, 'n', s.n, 'turns', s.turns, 'spread', s.spread, 'cross', s.cross)")).alias("s"), F.array_join("t", "").alias("j"))
    total = lambda field, where="true": F.sum(F.expr(f"aggregate(filter(s, x -> {where}), 0D, (a, x) -> a + {field})"))
    sums = [total(f, f"x.k = {k}").alias(f"{name}{k}") for k in ALPHABETS for name, f in (("t", "x.turns"), ("p", "x.n - 1"))]
    sums += [total("x.cross").alias("cross"), total("x.spread").alias("spread")]
    sums += [F.sum(F.length("j") - F.length(F.replace("j", F.lit(c)))).alias(f"s{i}") for i, c in enumerate(SYMBOLS)]
    got = {k: float(v or 0) for k, v in each.agg(*sums).first().asDict().items()}
    places, turns = (sum(got[f"{x}{k}"] for k in ALPHABETS) for x in "pt")
    rate = (turns + PRIOR_TURNS) / (places + PRIOR_PLACES)
    seen = {c: got[f"s{i}"] + 1 for i, c in enumerate(SYMBOLS)}

    def excess(k: int) -> float:
        q = [seen[c] + (seen[c.upper()] if k <= 36 and c.isalpha() else 0) for c in ALPHABETS[k]]
        return k * sum(v * v for v in q) / sum(q) ** 2 - 1

    return Written({k: excess(k) for k in ALPHABETS}, {k: (got[f"t{k}"] + POOLED * rate) / (got[f"p{k}"] + POOLED) for k in ALPHABETS}, got["cross"] / max(1.0, got["spread"]))


def _tested(tokens: str, like: Written) -> str:
    """SQL of tokens with the combined p-value of a written token (p), the least p-value of a random one (fit) and n."""
    of = lambda values: "CASE s.k " + " ".join(f"WHEN {k} THEN {v!r}D" for k, v in values.items()) + " END"
    bounded = lambda p: f"1 / tan(pi() * greatest({FLOOR!r}D, least(0.99D, {p})))"
    steps = [
        *_statistics("s.x.token"),
        ("chi", "s.k / s.n * aggregate(array_distinct(split(s.t, '')), 0D, (a, c) -> a + pow(length(s.t) - length(replace(s.t, c, '')), 2)) - s.n"),
        ("r", "CASE WHEN s.spread > 0 THEN s.cross / s.spread ELSE 1D END"),
        # of a written token: as even, as many turns, as little correlation as this
        ("far", f"(s.n - 1) * {of(like.excess)}"),
        ("p_chi", _lower_tail("(s.chi - (s.k - 1) - s.far) / sqrt(2 * (s.k - 1 + 2 * s.far))")),
        ("rate", of(like.turns)),
        ("f", "s.turns / (s.n - 1)"),
        # the binomial tail by its large-deviation expansion
        ("rare", "CASE WHEN s.f >= 1 THEN (s.n - 1) * ln(1 / s.rate) WHEN s.f > s.rate THEN (s.n - 1) * (s.f * ln(s.f / s.rate) + (1 - s.f) * ln((1 - s.f) / (1 - s.rate))) ELSE 0D END"),
        ("p_runs", "CASE WHEN s.f >= 1 THEN exp(-s.rare) WHEN s.f > s.rate THEN least(0.5D, exp(-s.rare) / (1 - s.rate * (1 - s.f) / (s.f * (1 - s.rate))) / sqrt(2 * pi() * (s.n - 1) * s.f * (1 - s.f))) ELSE 0.5D END"),
        ("p_serial", _lower_tail(f"(s.r - {like.serial!r}D) * sqrt(s.n)")),
        ("cauchy", "(" + " + ".join(bounded(f"s.{p}") for p in ("p_chi", "p_runs", "p_serial")) + ") / 3"),
        ("p", "CASE WHEN s.cauchy > 1000 THEN 1 / (pi() * s.cauchy) ELSE 0.5D - atan(s.cauchy) / pi() END"),
        # of a random token; Wilson-Hilferty: the cube root of chi-squared over its degrees of freedom is about normal
        ("z_chi", "(pow(s.chi / (s.k - 1), 1D / 3) - (1 - 2D / (9 * (s.k - 1)))) / sqrt(2D / (9 * (s.k - 1)))"),
        ("same", "aggregate(array('a', 'b', '0', '+', '/', '_', '-'), 0D, (a, c) -> a + pow((length(s.classes) - length(replace(s.classes, c, ''))) / s.n, 2))"),
        ("z_runs", "CASE WHEN s.same < 1 THEN (s.changes - (s.n - 1) * (1 - s.same)) / sqrt((s.n - 1) * (1 - s.same) * s.same + 0.25D) ELSE 0D END"),
        ("z_serial", "s.r * sqrt(s.n)"),
        ("fit", "6 * least(" + ", ".join(_lower_tail(f"-abs(s.{z})") for z in ("z_chi", "z_runs", "z_serial")) + ")"),
    ]
    return _stepped(tokens, steps, "named_struct('start', s.x.start, 'stop', s.x.stop, 'n', s.n, 'p', s.p, 'fit', s.fit)")


def _joined(spans: str) -> str:
    return f"array_join(transform(array_sort({spans}, (a, b) -> CASE WHEN a.start < b.start OR (a.start = b.start AND a.rank < b.rank) THEN -1 WHEN a.start = b.start AND a.rank = b.rank THEN 0 ELSE 1 END), s -> concat_ws(':', s.kind, s.start, s.stop)), ',')"


def _cut(tested: DataFrame) -> tuple[float, float]:
    """(mean length, largest weighted p-value) of the discoveries among all candidates."""
    each = tested.where(F.size("tested") > 0).select(F.explode("tested").alias("s")).select("s.*")
    mean, m = each.agg(F.avg("n"), F.count("*")).first()
    if not m:
        return 1.0, -1.0
    q = F.col("p") * F.lit(mean) / F.col("n")
    bucket = F.floor(-F.log2(F.greatest(q, F.lit(2.0**-DEEPEST))) * STEPS)
    seen, cut = 0, -1.0
    # one row per bucket at most; a bucket's least power of two bounds its p-values from above
    for r in each.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).orderBy(F.desc("bucket")).collect():
        seen += r.n
        if (top := 2.0 ** (-r.bucket / STEPS)) * m <= FALSE_DISCOVERIES * seen:
            cut = top
    return mean, cut


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Null and empty texts have no span (base_sha256 is that of an empty string). Places are code points, the end
    exclusive. A token that overlaps a base span adds none. Repeated rows are scanned alike, a null doc_id stays null,
    other columns are not read; an empty table gives an empty result. Two passes over the texts, one over the spans;
    only sums and a histogram are exchanged.
    """
    like = learned(docs)
    plain = "s -> named_struct('start', s.start, 'stop', s.stop, 'rank', s.rank, 'kind', s.kind)"
    out = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = out.select("doc_id", *[F.expr(_spans(kind, rank, pattern, group, least)).alias(kind) for rank, (kind, pattern, group, least) in enumerate(KINDS)], F.expr(_spans("random", 3, CANDIDATE, 0, 16)).alias("tokens"))
    base = "concat(" + ", ".join(f"transform({k[0]}, {plain})" for k in KINDS) + ")"
    out = out.select("doc_id", *[F.size(k[0]).cast("long").alias(f"n_{k[0]}") for k in KINDS], F.expr(base).alias("base"), "tokens")
    out = out.select(*[c for c in out.columns if c != "tokens"], F.expr(f"CASE WHEN size(tokens) > 0 THEN {_tested('tokens', like)} END").alias("tested"))
    out = common.stored(out, "tested")
    mean, cut = _cut(out)
    fine = f"filter(tested, s -> s.p * {mean!r}D / s.n <= {cut!r}D AND s.fit >= {CONSISTENT}D AND NOT exists(base, b -> b.start < s.stop AND s.start < b.stop))"
    out = out.withColumn("random", F.expr(f"coalesce(transform({fine}, s -> named_struct('start', s.start, 'stop', s.stop, 'rank', 3, 'kind', 'random')), CAST(array() AS array<struct<start:bigint,stop:bigint,rank:int,kind:string>>))"))
    return out.select("doc_id", *[f"n_{k[0]}" for k in KINDS], F.sha2(F.expr(_joined("base")).cast("binary"), 256).alias("base_sha256"), F.expr(_joined("concat(base, random)")).alias("spans"), F.size("random").cast("long").alias("n_random"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(common.documents(spark, sf_dir))
