"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import random
import re
import string
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from layerwise.llm import common, decontaminate, language, licenses, mixing, range_coder, secrets, simhash, token_ids, toxicity, url_filter, vector_graph
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
INSULTS = ["idiot", "moron", "trash"]


def docs(spark, rows):
    """Rows (id, text[, lang, source]) as documents, with columns whose names the operators use themselves."""
    full = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "a")), 0) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    for name in ("size", "fp", "start", "score", "label", "rule", "q", "u", "base", "lines", "component_id", "__y"):
        df = df.withColumn(name, F.lit("x"))
    return df


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "or", "in", "st", "re"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


ODD = [(None, None, None, None), (7, None, None, None), (8, "", "en", None), (9, " \t\n", "en", "b"), (10, "a" * 200_000, "en", "b"), (11, "same", "en", "a"), (11, "same", "en", "a"), (12, "\u00e9\U0001f600 x", "fr", "a")]


# 1


def test_range_coder_round_trip_and_checksum():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, int), np.array([65535]), rng.integers(0, 65536, 20_001), np.repeat(rng.integers(0, 300, 4000), 9), np.zeros(70_000, int)):
        frame = range_coder.write_block([5, None], [len(ids), 0], ids, 3)
        first, names, lengths, back = range_coder.read_block(frame)
        assert first == 3 and names == [5, None] and lengths.tolist() == [len(ids), 0] and (back == ids).all()
        for at in (len(frame) - 1, 40):
            bad = bytearray(frame)
            bad[at] ^= 1
            with pytest.raises(ValueError, match="BLOCK_"):
                range_coder.read_block(bytes(bad))
    with pytest.raises(ValueError, match="TOKEN_ID_RANGE"):
        range_coder.write_block([1], [1], np.array([65536]), 0)


def test_token_ids(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_ids, "BLOCK_IDS", 500)
    rng = random.Random(2)
    rows = [r for r in ODD if r[0] is not None] + [(i + 100, prose(rng, 60) + ". Don't, STOP! \u00dcber \u00df\u00c9 <|endoftext|> 12,5\x1c\u2003z\u0301") for i in range(40)]
    got = sorted(token_ids.round_trip(docs(spark, rows)).collect(), key=lambda r: (r.doc_id, r.start))
    t, start = Tokenizer.from_file(token_ids.tokenizer_path()), 0
    assert len(got) == len(rows)
    for r, (doc, text, *_) in zip(got, sorted(rows, key=lambda r: r[0]), strict=True):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_ids.round_trip(docs(spark, [])).count() == 0


def test_range_coder_mixes_orders():
    """Ids drawn from a chain of order 1 with copies: the coder gets below the entropy of single ids and that of the chain."""
    rng = np.random.default_rng(21)
    follow = rng.integers(0, 5000, (5000, 4))
    chain = [0]
    for k in rng.integers(0, 4, 150_000):
        chain.append(follow[chain[-1], k])
    ids = np.array([*chain, *chain[:100_000]])
    bits = 8 * len(range_coder.write_block([1], [len(ids)], ids, 0)) / len(ids)
    share = np.bincount(ids) / len(ids)
    share = share[share > 0]
    assert bits < 0.5 * -(share * np.log2(share)).sum()
    assert (range_coder.read_block(range_coder.write_block([1], [len(ids)], ids, 0))[3] == ids).all()


def test_a_worker_holds_little_memory():
    rng = np.random.default_rng(5)
    ids = (rng.zipf(1.2, 1 << 22) % 49_152).astype(np.uint16)
    tracemalloc.start()
    token_ids._encoder(token_ids.tokenizer_path()).encode([b"a few words"])
    with_table = tracemalloc.get_traced_memory()[0]
    token_ids._forget()
    without = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    frame = range_coder.write_block([1], [len(ids)], ids, 0)
    peak = tracemalloc.get_traced_memory()[1] - without
    tracemalloc.stop()
    assert with_table - without > with_table / 2 and with_table < 100 << 20 and peak < 200 << 20
    assert (range_coder.read_block(frame)[3] == ids).all()


def test_small_batches(spark):
    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, rows = spark.conf.get(key), spark.range(0, 1000, 1, 1).mapInArrow(count, "n long")
    with pytest.raises(ValueError, match="odd"), common.small_batches(spark, 100):
        assert sorted(r.n for r in rows.collect()) == [100] * 10
        raise ValueError("odd")
    assert spark.conf.get(key) == before
    spark.conf.set(key, "50")
    with common.small_batches(spark, 100):  # a smaller one holds
        assert spark.conf.get(key) == "50"
    spark.conf.set(key, before)


def test_pieces_are_told_apart_by_their_bytes():
    from tokenizers import Tokenizer

    rng, t, e = random.Random(22), Tokenizer.from_file(token_ids.tokenizer_path()), token_ids._Encoder(token_ids.tokenizer_path())
    parts = [*"abAB.,;:!?'- \n\t\x00\x1c \u00e9\u00df\u00c9\u6570", "a\x00", "word", "<|", "12", "longerthansixteenletters", "exactlyeightbyte"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    for _ in range(2):  # the second time from the table
        for text, ids in zip(texts, e.encode([x.encode() for x in texts]), strict=True):
            assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


def test_marks_after_letters_part_pieces(monkeypatch):
    """Words with marks behind them reach the tokenizer as words, many at a time, and each of them once."""
    from tokenizers import Tokenizer

    t, e, alone = Tokenizer.from_file(token_ids.tokenizer_path()), token_ids._Encoder(token_ids.tokenizer_path()), []
    assert e.bare is not e.tokenizer
    one = token_ids._Encoder.one
    monkeypatch.setattr(token_ids._Encoder, "one", lambda self, pieces: alone.extend(pieces) or one(self, pieces))
    words = ["tion", "on\u00e9", "\u00c9t\u00e9", "\u00e0\u00ff", "gro\u00df", "o\u00f1a"]
    texts = [" ".join(w + m for w in words for m in ("", "&&&", ".***", ",", "/(", "?!`", "{~}"))]
    texts += ["x\u00d7, y\u00f7= \u2026. n\u0303. =\u0338 a=\u0338 don't we'll rock'n'roll a'\u0301s \u00e9's \u00aa. \u00b5, a_b-c"]
    for text, ids in zip(texts, e.encode([x.encode() for x in texts]), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids
    assert not any(w.lower() in p.lower() for p in alone for w in words)


@pytest.mark.parametrize(("steps", "renewals"), [(256, 9), (257, 9), (300, 10)])
def test_frequencies_are_renewed_only_for_enough_steps(monkeypatch, steps, renewals):
    """The first renewal is that of an empty model; one for a last step or two would cost more than all others."""
    seen, renew = [], range_coder._Model._renew
    monkeypatch.setattr(range_coder, "LANES", 64)
    monkeypatch.setattr(range_coder._Model, "_renew", lambda self: seen.append(self.step) or renew(self))
    ids = np.random.default_rng(6).zipf(1.3, 64 * (steps - 1) + 5) % 50_000
    frame = range_coder.write_block([1], [len(ids)], ids, 0)
    assert len(seen) == renewals
    assert (range_coder.read_block(frame)[3] == ids).all()


def test_range_coder_at_the_ends_of_its_shares():
    """Long runs make order 2 all but sure; then what it misses, and what no order has seen, gets the least share. They
    are of the last id, so that its pair is beyond all keys."""
    rng = np.random.default_rng(7)
    for n in (1, 127, 128, 40_000):
        for rare in (0.5, 0.01, 0.0005):
            ids = np.where(rng.random(n) < rare, rng.integers(0, 65536, n), 65535)
            assert (range_coder.read_block(range_coder.write_block([1], [n], ids, 0))[3] == ids).all()


# 2


def _base(text):
    text = text or ""
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    out = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    out.sort()
    return out


def test_secrets(spark):
    rng = random.Random(3)
    b64 = string.ascii_letters + string.digits + "+/"
    rows = ODD + [(20, "x " + "".join(rng.choice(b64) for _ in range(44)) + " y"), (21, "password=token:abcdefgh"), (22, "\u00e9\U0001f600 Token = 'abcdef' AKIA" + "Z9" * 9), (23, "deadbeef" * 4 + "g"), (24, "thisIsAName2OfAMethod and 2024-01-01-10-00-00 nothingsecretatallhere12"), (25, "AKIAAKIA" + "1" * 12 + " api_key:aaaaa")]
    got = secrets.scanned(docs(spark, rows)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for doc, text, *_ in rows:
        b, r = _base(text), by[doc]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in b) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{x[2]}:{x[0]}:{x[3]}" for x in b).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == [f"{x[2]}:{x[0]}:{x[3]}" for x in b]
    assert by[20].spans == "random:2:46" and by[24].n_random == 0 and secrets.scanned(docs(spark, [])).count() == 0


def _battery(token, like):
    """(combined p-value of a written token, p-value of a random one, length), in plain Python."""
    t = token.rstrip("=")
    n, tail = len(t), lambda z: 1 / (1 + math.exp(min(700, -(1.5976 * z + 0.07056 * z**3))))
    k = 16 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", t) else 36 if re.fullmatch("[0-9a-z]+|[0-9A-Z]+", t) else 52 if re.fullmatch("[A-Za-z]+", t) else 64
    classes = ["a" if c.islower() else "b" if c.isupper() else "0" if c.isdigit() else c for c in t]
    changes = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
    merged = re.sub("[0-9]", "0", re.sub("[A-Z]", "b", re.sub("[A-Z]?[a-z]+", "a", t)))
    turns = sum(a != b for a, b in zip(merged, merged[1:], strict=False))
    x = np.array([secrets.SYMBOLS.index(c) + 1 for c in t], float)
    x -= x.mean()
    r = float(x[:-1] @ x[1:] / (x @ x)) if x.any() else 1.0
    chi = k / n * sum(t.count(c) ** 2 for c in set(t)) - n
    far, rate, f = (n - 1) * like.excess[k], like.turns[k], turns / (n - 1)
    runs = 0.5
    if f >= 1:
        runs = rate ** (n - 1)
    elif f > rate:
        rare = math.exp(-(n - 1) * (f * math.log(f / rate) + (1 - f) * math.log((1 - f) / (1 - rate))))
        runs = min(0.5, rare / (1 - rate * (1 - f) / (f * (1 - rate))) / math.sqrt(2 * math.pi * (n - 1) * f * (1 - f)))
    ps = tail((chi - (k - 1) - far) / math.sqrt(2 * (k - 1 + 2 * far))), runs, tail((r - like.serial) * math.sqrt(n))
    cauchy = sum(1 / math.tan(math.pi * max(1e-15, min(0.99, p))) for p in ps) / 3
    p = 1 / (math.pi * cauchy) if cauchy > 1000 else 0.5 - math.atan(cauchy) / math.pi
    same = sum((classes.count(c) / n) ** 2 for c in set(classes))
    spread = 2 / (9 * (k - 1))
    z = ((chi / (k - 1)) ** (1 / 3) - 1 + spread) / math.sqrt(spread), (changes - (n - 1) * (1 - same)) / math.sqrt((n - 1) * (1 - same) * same + 0.25) if same < 1 else 0, r * math.sqrt(n)
    return p, 6 * min(tail(-abs(v)) for v in z), n


ALPHABETS = {"HEX": "0123456789ABCDEF", "hex": "0123456789abcdef", "b36": string.ascii_lowercase + string.digits, "letters": string.ascii_letters, "b64": string.ascii_letters + string.digits + "+/"}


def test_battery(spark):
    """Spans of the battery against plain Python, its power by alphabet and length, and its false discoveries."""
    rng, rows, kind = random.Random(23), [], {}
    word = lambda: "".join(rng.choice(["an", "the", "or", "in", "st", "re", "tion", "keit"]) for _ in range(rng.randint(2, 9)))
    for i in range(1500):
        written = [w.title() if rng.random() < 0.1 else w for w in (word() for _ in range(40))]
        rows.append((i, " ".join([*written, word().title() + word().title() + str(rng.randint(1, 2030)), f"{word()}-{word()}_{rng.randint(0, 99)}"])))
    for name, letters in ALPHABETS.items():
        for n in (20, 32, 48):
            for _ in range(40):
                kind[len(rows)] = name, n
                rows.append((len(rows), "x " + "".join(rng.choice(letters) for _ in range(n)) + " y"))
    rows.append((len(rows), " ".join(["deadbeef" * 4, "AKIA" + "Z9" * 9, "Q9" * 30] * 900)))  # thousands of spans
    df = docs(spark, rows)
    like, got = secrets.learned(df), {r.doc_id: r for r in secrets.scanned(df).collect()}
    found = [(d, m.start(), m.end(), *_battery(m[0], like)) for d, t in rows for m in re.finditer(secrets.CANDIDATE, t)]
    mean = sum(x[5] for x in found) / len(found)
    level = lambda x: math.floor(-math.log2(max(x[3] * mean / x[5], 2.0**-secrets.DEEPEST)) * secrets.STEPS)
    cut = -1.0
    for b in sorted({level(x) for x in found}, reverse=True):
        if 2 ** (-b / secrets.STEPS) * len(found) <= secrets.FALSE_DISCOVERIES * sum(level(x) >= b for x in found):
            cut = 2 ** (-b / secrets.STEPS)
    want = {}
    for d, a, b, p, fit, n in found:
        if p * mean / n <= cut and fit >= secrets.CONSISTENT and not any(x < b and a < y for x, _, _, y in _base(rows[d][1])):
            want.setdefault(d, []).append(f"random:{a}:{b}")
    assert {d: [s for s in r.spans.split(",") if s.startswith("random")] for d, r in got.items() if r.n_random} == want
    power = {}
    for d, k in kind.items():
        power[k] = power.get(k, 0) + bool(got[d].n_random or got[d].n_hex)
    print(power)
    assert all(v >= (38 if n >= 32 else 28) for (_, n), v in power.items()), power
    false = sum(got[d].n_random for d in range(1500))
    assert false <= 0.05 * sum(r.n_random for r in got.values())
    last = got[len(rows) - 1]
    assert (last.n_access, last.n_hex) == (900, 900) and [s for s in last.spans.split(",") if s] == [f"{x[2]}:{x[0]}:{x[3]}" for x in _base(rows[-1][1])]


# 3


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 8))
    rows, n = [], 0
    for i, v in enumerate(base):
        for k in range(i % 4 + 1):
            near = v if k == 1 else v + rng.normal(size=8) * (0.02 if k < 3 else 0.06) * k
            rows.append((n, [float(np.float32(x)) for x in near], i % 2 if i < 50 else None))
            n += 1
    rows += [(n, [0.0] * 8, 0), (n + 1, None, 0), (n + 2, [float("nan")] * 8, 0), (n + 3, [1.0, None], 0), (None, [1.0] * 8, 0), (n + 4, [], 0), (n + 5, [2.0, 0.0], 0), (n + 6, [4.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("near", F.lit(1)).withColumn("copies", F.lit(1))
    got = {r.vec_id: r for r in vector_graph.near_duplicates(df).collect()}
    assert len(got) == len(rows)

    def links(a, b):
        if a[2] is None or a[2] != b[2] or a[0] is None or b[0] is None:
            return False
        x, y = a[1], b[1]
        if not x or not y or len(x) != len(y) or any(v is None or not np.isfinite(v) for v in x + y) or not any(x) or not any(y):
            return False
        x, y = np.array(x, float), np.array(y, float)
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98

    near = {r[0]: [s[0] for s in rows if s is not r and links(r, s)] for r in rows}
    for v, r in got.items():
        seen, todo = {v}, [v]
        while todo:
            todo += [w for w in near.get(todo.pop(), []) if w not in seen and not seen.add(w)]
        low = min(seen) if v is not None else None
        assert (r.n_links, r.component_id, r.kept) == (len(near.get(v, [])), low, v == low)
    assert vector_graph.near_duplicates(df.limit(0)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(300, 16))
    x = vector_graph._unit(np.concatenate([centre, centre + rng.normal(size=centre.shape) * 0.05, np.repeat(centre[:3], 200, 0) + rng.normal(size=(600, 16)) * 0.03]))
    n = len(x)
    s = x @ x.T >= 0.98
    np.fill_diagonal(s, False)
    every, ones = np.ones(n, bool), np.ones(n, np.int64)
    for exact in (False, True):
        counts, root = vector_graph.linked(x, np.arange(n), ones, every, every, exact)
        assert (counts <= s.sum(1)).all() and counts.sum() >= (1 if exact else 0.9) * s.sum()
        assert exact <= all(root[i] == root[j] for i, j in zip(*np.nonzero(s), strict=True))
    assert vector_graph.Graph(x).beam(np.arange(n)) in vector_graph.BEAMS


def test_dealt_shards_hold_all_links():
    rng = np.random.default_rng(24)
    x = vector_graph._unit(rng.normal(size=(4000, 12)))
    y = vector_graph._unit(x + rng.normal(size=x.shape) * 0.05)
    c = vector_graph.centres(x, 60)
    near = np.einsum("ij,ij->i", x, y) >= 0.98
    assert near.sum() > 1000
    for a, b, fine in zip(vector_graph.dealt(x, c), vector_graph.dealt(y, c), near, strict=True):
        assert not fine or (a[0] in b and b[0] in a)


@pytest.mark.parametrize("shard, most", [(8_000, 16_000), (400, 600)])
def test_whole_table_recall(spark, monkeypatch, shard, most):
    """Planted pairs and a large group of like vectors, over many shards and blocks of shards, against brute force."""
    monkeypatch.setattr(vector_graph, "SHARD_ROWS", shard)
    monkeypatch.setattr(vector_graph, "MOST_ROWS", most)
    rng = np.random.default_rng(25)
    c = rng.normal(size=(800, 24))
    x = np.concatenate([c, c + rng.normal(size=c.shape) * 0.1, rng.normal(size=24) + rng.normal(size=(1500, 24)) * 0.08])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vector_graph.near_duplicates(df).collect()}
    u = vector_graph._unit(x)
    s = u @ u.T >= 0.98
    np.fill_diagonal(s, False)
    low = np.arange(len(x))
    while True:
        new = np.minimum(low, np.where(s, low, len(x)).min(1))
        if (new == low).all():
            break
        low = new
    assert s.sum() > 100_000 and sum(r.n_links for r in got.values()) >= 0.9999 * s.sum()
    assert sum(got[i].component_id == low[i] for i in range(len(x))) >= len(x) - 2


# 4


def _simhash(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rng = random.Random(6)
    rows = [r for r in ODD if r[0] is not None]
    for i in range(25):
        words = prose(rng, 120).split()
        for k in range(4):
            w = words.copy()
            for _ in range(k):
                w[rng.randrange(len(w))] = "ZZ"
            rows.append((100 + len(rows), " ".join(w)))
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    fps = [(d, _simhash(t)) for d, t, *_ in rows]
    assert sorted((r.doc_id, r.fingerprint) for r in got) == sorted((d, f"{f:016x}") for d, f in fps)
    comp = {}
    for _, f in fps:
        seen, todo = {f}, [f]
        while todo:
            a = todo.pop()
            todo += [b for _, b in fps if (a ^ b).bit_count() <= 3 and b not in seen and not seen.add(b)]
        comp[f] = min(d for d, g in fps if g in seen)
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((d, comp[f]) for d, f in fps)
    kept = simhash.deduplicate(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(comp.values())) and kept.columns == docs(spark, []).columns
    assert simhash.near_duplicates(docs(spark, [])).count() == 0 and simhash.near_duplicates(docs(spark, ODD)).count() == len(ODD)


def test_simhash_keeps_one_document_of_each_component(spark):
    rng = random.Random(16)
    text = [prose(rng, 80) for _ in range(6)]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (None, text[2]), (30, text[2]), (31, text[3]), (31, text[4]), (31, text[4]), (32, text[5]), (33, text[5])]
    kept = [(r.doc_id, r.text) for r in simhash.deduplicate(docs(spark, rows)).collect()]
    want = [(None, text[0]), (None, text[1]), (30, text[2]), (31, text[3]), (31, text[4]), (32, text[5])]
    assert sorted(kept, key=str) == sorted(want, key=str)
    assert simhash.deduplicate(docs(spark, ODD)).where("doc_id IS NULL").count() == 0


def test_gray_index_finds_all_links(monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    flips = np.array([np.bitwise_xor.reduce([np.uint64(1) << np.uint64(b) for b in rng.integers(0, 64, k)]) for k in rng.integers(1, 6, 1200)], np.uint64)
    values = np.unique(np.concatenate([x, np.repeat(x, 3) ^ flips]))
    a, b = simhash._near(values)
    assert (np.bitwise_count(gray := simhash.gray_rank(values)) >= 0).all() and len(set(gray.tolist())) == len(values)
    parent = {int(v): int(v) for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for u, v in zip(a.tolist(), b.tolist(), strict=True):
        parent[root(u)] = root(v)
    for i, v in enumerate(values):
        for w in values[i + 1 :][np.bitwise_count(values[i + 1 :] ^ v) <= 3]:
            assert root(int(v)) == root(int(w))


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(0, 0), (None, 3)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for v in near:
        seen, todo = {v}, [v]
        while todo:
            todo += [w for w in near[todo.pop()] if w not in seen and not seen.add(w)]
        assert got.pop(v) == min(seen)
    assert not got


# 5


def _edits(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, 25)) for i in range(6)] + [(50, "tiny"), (51, None), (None, "x y z"), (52, " ")]
    rows = list(ODD)
    for i, text in items[:6]:
        for k in (0, 2, int(0.1 * len(text)), int(0.2 * len(text))):
            t = list(text)
            for at in rng.sample(range(len(t)), k):
                t[at] = rng.choice(["q", "", t[at] + "w"])
            rows.append((100 + len(rows), prose(rng, 80) + " " + "".join(t).upper().replace(" ", "\n") + " " + prose(rng, 40)))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {r.doc_id: r for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    index = decontaminate.build([(i, decontaminate.normal(t)) for i, t in items if t and i is not None and t.strip()])
    budget = dict(zip(index.ids, index.budget.tolist(), strict=True))
    for doc, text, *_ in rows:
        want = {i: e for i, p in zip(index.ids, index.texts, strict=True) if (e := _edits(p, decontaminate.normal(text))) <= budget[i]} if len(text or "") < 5000 else {}
        assert dict(zip(got[doc].item_ids, got[doc].edits, strict=True)) == want, doc
    clean = decontaminate.decontaminate(docs(spark, rows), bench)
    assert clean.count() == sum(not (r and got[r[0]].contaminated) for r in rows) and clean.columns == docs(spark, []).columns
    assert not any(r.contaminated for r in decontaminate.contaminated(docs(spark, rows), bench.limit(0)).collect())


def test_decontamination_in_slices(spark, monkeypatch):
    """A benchmark of several slices gives what one slice gives, for all rows and columns."""
    rng = random.Random(26)
    items = [(i, prose(rng, 25)) for i in range(12)] + [(3, prose(rng, 20))]
    rows = ODD + [(100 + i, prose(rng, 60) + " " + items[i % 13][1] + " " + items[i * 5 % 13][1]) for i in range(20)] + [(120, prose(rng, 50))] * 2
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, decontaminate.contaminated(docs(spark, rows), bench).collect()))
    kept = sorted(map(str, decontaminate.decontaminate(docs(spark, rows), bench).collect()))
    monkeypatch.setattr(decontaminate, "SLICE_CHARS", 500)
    assert decontaminate._slices(bench)[0] > 3
    assert sorted(map(str, decontaminate.contaminated(docs(spark, rows), bench).collect())) == want
    assert sorted(map(str, decontaminate.decontaminate(docs(spark, rows), bench).collect())) == kept


def test_decontamination_index_is_small():
    rng = np.random.default_rng(27)
    text = "".join(map(chr, rng.integers(97, 123, 400_000)))
    index = decontaminate.build([(i, text[i * 400 : i * 400 + 400]) for i in range(1000)])
    held = sum(getattr(index, f).nbytes for f in ("bits", "values", "ends", "item", "at"))
    assert held * decontaminate.SLICE_CHARS / len(text) <= 100e6


# 6


def test_language(spark):
    rng = random.Random(10)
    parts = {"xx": ["ka", "ku", "wo"], "yy": ["\u00e9l", "\u00e8m", "ou"], "zz": ["sch", "\u00fc", "ei"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=2)) for _ in range(30)), lang, "s") for i in range(240) for lang in [list(parts)[i % 3]]]
    df = docs(spark, rows + [r for r in ODD if r[0] is not None][:3] + [(999, "123 !?", "xx", "s"), (None, "ka ku", "xx", "s")])
    got = {r.doc_id: r for r in language.identified(df, language.train(df)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1 for i, *_ in rows)
    assert [(got[i].lang_pred, got[i].score) for i in (7, 8, 9, 999)] == [("und", 0.0)] * 4 and not got[None].held_out
    # predictions against plain Python, repeated ids, and characters that are no letters
    twice = docs(spark, [*rows, *[(i, t[::-1], "yy", "s") for i, t, *_ in rows[:60]]])
    model = language.train(twice)
    again = language.train(twice.repartition(7))
    assert model.langs == again.langs and (model.weight == again.weight).all()
    for text in (rows[0][1], rows[1][1] + " A", "ka"):
        z = np.zeros(len(model.langs))
        whole = sum(n * model.idf[g] for g, n in enumerate(language.grams(text)) if n)
        for g, n in enumerate(language.grams(text)):
            if n:
                z += n * model.idf[g] / whole * model.weight[g]
        p = np.exp((z + model.bias) / model.temperature)
        names, scores = model.predict([text])
        assert names == [model.langs[int(p.argmax())]] and scores[0] == pytest.approx(p.max() / p.sum())
    assert [language.has_letter(x) for x in ("\u00bd 12", "\u00b2\u2167", "_1", "\u00bda", "\u6570", "\u02b0", None)] == [False, False, False, True, True, True, False]
    empty = docs(spark, [])
    assert language.identified(df, language.train(empty)).where("lang_pred <> 'und' OR score <> 0").count() == 0


# 7


def test_urls(spark):
    urls = [None, "", "nothing", "https://EXAMPLE.org/es/1", "http://a.example.org/en/12?x#y", "http://a.example.org/en/2", "https://x.com/fr/3#t", "https://x.com/de/4", "https://x.com", "https://notorg/de/", "ftp://x.net?a=/b://c", "https://x.com/de/4"]
    urls += [f"https://y.com/de/{i}.html" for i in range(30)] + [f"https://y.com/pt/{i}.html" for i in range(3)] + [f"https://w.net/{'abc'[i % 3]}{i}/z" for i in range(90)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("x")).withColumn("raw", F.lit("x"))
    got = {r.page_id: r for r in url_filter.judged(df).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path, host = re.match(r"[^?#]*", rest[len(host) :])[0], host.lower()
        fits = [(len(t), k, t) for k, t in url_filter.RULES for h, p in [t.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[2] if fits else None)
        assert r.verdict in ("allow", "block") and (not fits or r.verdict == max(fits)[1])
    assert {r.template for r in got.values() if r.host == "w.net"} == {"/*/z"}
    _as_sql(df, got.values(), url_filter._sql())
    assert url_filter.judged(df.limit(0)).count() == 0


def _as_sql(df, got, sql):
    con = duckdb.connect()
    con.register("pages", df.select("page_id", "url").toArrow())
    want = con.execute(sql).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got))) == sorted(map(repr, want))


def test_urls_back_off_to_the_domain_and_to_all_hosts(spark):
    rules = [("block", "a.shop.com/sale/"), ("allow", "a.shop.com/help/"), ("block", "spam.net/win/"), ("block", "junk.net/win/")]
    urls = [f"https://a.shop.com/{s}/{i}" for s in ("sale", "help") for i in range(30)] + [f"https://{h}.net/win/{i}" for h in ("spam", "junk") for i in range(20)]
    urls += [f"https://b.shop.com/{s}/{i}" for s in ("sale", "help", "news") for i in range(9)] + [f"https://other.org/{s}/{i}" for s in ("win", "about") for i in range(9)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judged(df, rules).collect()
    said = {(r.host, r.path.split("/")[1]): (r.verdict, r.evidence) for r in got if r.rule is None}
    assert said == {("b.shop.com", "sale"): ("block", "domain"), ("b.shop.com", "help"): ("allow", "domain"), ("b.shop.com", "news"): ("allow", "none"), ("other.org", "win"): ("block", "all"), ("other.org", "about"): ("allow", "none")}
    _as_sql(df, got, url_filter._sql(rules))


@pytest.mark.parametrize("sections", [20, 100])
def test_urls_of_many_sections_and_deep_paths(spark, sections):
    # the example of many sections: labelled ones stay apart from those without labels, at any count
    urls = [f"https://y.com/de/{i}" for i in range(1000)] + [f"https://y.com/fr/{i}" for i in range(20)]
    urls += [f"https://y.com/section{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}/{k}" for i in range(sections) for k in range(3)]
    # and a rule's pages deep down are no reason to block others as deep
    deep = "/".join("abcdefghi")
    rules = (*url_filter.RULES, ("block", f"deep.net/{deep}/bad/"), ("allow", f"deep.net/{deep}/good/"))
    urls += [f"https://deep.net/{deep}/bad/{i}" for i in range(300)] + [f"https://deep.net/{deep}/good/{i}" for i in range(20)]
    urls += [f"https://deep.net/{deep}/other/{i}" for i in range(5)] + ["https://deep.net/" + "z/" * 40]
    got = url_filter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert len(got) == len(urls) and {r.verdict for r in got if r.rule is None} == {"allow"}
    _as_sql(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), got, url_filter._sql(rules, 11))
    assert {r.template for r in got if r.path.startswith("/de/")} == {"/de/{n}"} and {r.template for r in got if r.path.startswith("/fr/")} == {"/fr/{n}"}


# 8


def test_licenses(spark):
    rows = list(ODD) + [(20, "Intro\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License.\nA driving licence is required to rent a car."), (21, "We say: this work is LICENSED under the GNU General Public License, version 3. Thanks."), (22, "Licensed under CC BY-NC 4.0."), (22, "Licensed under CC BY-NC 4.0."), (23, "a licence for dogs"), (24, "All rights reserved.")]
    got = licenses.scanned(docs(spark, rows), licenses.fit()).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert (by[20].families, by[20].n_unknown, by[20].places) == (["Apache-2.0", "MIT"], 1, "1:Apache-2.0,2:MIT,3:unknown")
    assert by[21].families == ["GPL-3.0"] and by[22].n_licenses == 1 and by[23].n_licenses == 0 and by[24].families == ["proprietary"]
    assert all(by[i].places == "" for i in (7, 8, 9, 10, 11)) and licenses.scanned(docs(spark, []), licenses.fit()).count() == 0


def test_licenses_wrapped_over_lines(spark):
    import textwrap

    want = {"MIT": 1, "GPL-3.0": 1, "BSD": 2, "ISC": 0}
    rows = []
    for at, (family, n) in enumerate(want.items()):
        for k, (width, mark) in enumerate([(78, ""), (40, "# "), (24, " * ")]):
            lines = textwrap.wrap(licenses.NOTICES[family][n], width)
            rows.append((100 * at + k, "\n".join(["Some code", "", *(mark + x for x in lines), mark.rstrip(), "more code", "and a driving licence is required to rent a car."])))
    got = {r.doc_id: r for r in licenses.scanned(docs(spark, rows), licenses.fit()).collect()}
    for at, family in enumerate(want):
        for k in range(3):
            r = got[100 * at + k]
            assert (r.families, r.n_licenses) == ([family], 1), r


def test_whole_licences_other_languages_and_unknown(spark):
    import textwrap

    cut = lambda text, width=80: "\n".join(textwrap.wrap(text, width))
    mit, bsd = licenses.NOTICES["MIT"], licenses.NOTICES["BSD"]
    rows = [
        (1, "Copyright (c) 2020 A\n\n" + "\n\n".join(cut(x) for x in mit[2:5])),
        (2, "\n\n".join(cut(x) for x in bsd[2:7])),
        (3, "Lizenziert unter der Apache Lizenz, Version 2.0."),
        (4, "Publi\u00e9 sous licence MIT."),
        (5, "Licensed under the EUPL, Version 1.2 or as soon they will be approved\nby the European Commission - subsequent versions of the EUPL."),
        (6, "Licensed under the Frobnicate Public Pact, as agreed with the licensor in Utopia.\nThis licence is granted to penguins."),
        (7, "Nothing of the kind here."),
    ]
    got = {r.doc_id: r for r in licenses.scanned(docs(spark, rows), licenses.fit()).collect()}
    assert [got[i].families for i in range(1, 6)] == [["MIT"], ["BSD"], ["Apache-2.0"], ["MIT"], ["EUPL-1.2"]]
    assert (got[6].families, got[6].n_unknown, got[7].n_unknown) == ([], 2, 0)
    assert all(re.search(licenses.CUE, x) and len(x.split()) <= licenses.WORDS for f in licenses.NOTICES.values() for x in f)
    # the classifier against plain Python
    model = licenses.fit()
    keys = {str(i): t for i, t in enumerate([mit[0], "a driving licence", bsd[1] + " and more", "x", ""])}
    df = spark.createDataFrame(list(keys.items()), "key string, paragraph string")
    for r in licenses.classified(df, model).collect():
        g = licenses.grams(keys[r.key])
        z = (sum((np.array(model.weight[x]) for x in g if x in model.weight), np.zeros(len(model.classes))) / max(1, len(g)) ** 0.5 + model.bias) / model.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        guess = model.classes[int(p.argmax())]
        pairs = [{x for x in licenses.grams(n) if " " in x} or licenses.grams(n) for n in licenses.NOTICES.get(guess, [])]
        like = max((len(x & g) / len(x) for x in pairs), default=0.0)
        assert r.probability == pytest.approx(p.max()) and r.likeness == pytest.approx(like)
        assert r.family == (guess if p.max() >= licenses.SURE and like >= licenses.CONFIRMED else "unknown")


# 9


def test_mixing(spark):
    rng = random.Random(11)
    rows = list(ODD) + [(100 + i, prose(rng, rng.randint(0, 60)), "en", rng.choice(["a", "b", "c", "d", "\u00e9", None])) for i in range(400)]
    got = mixing.mixed(docs(spark, rows)).collect()
    sizes = {}
    for d, t, _, s, *_ in rows:
        sizes.setdefault(s, []).append(len(WORD.findall(t or "")))
    order = sorted((s for s in sizes if s is not None), key=str) + [None]
    total, target = 1.5 * sum(map(sum, sizes.values())), {}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    while True:  # excess is dealt out again until none is above its limit
        free = [s for s in order if s not in target]
        left = total - sum(target.values())
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) >= 2 * sum(sizes[s])]
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        target |= {s: 2.0 * sum(sizes[s]) for s in over}
    source = {d: s for d, _, _, s, *_ in rows}
    taken = {s: 0 for s in order}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sum(sizes[s]) and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= max(sizes[s]) for s in order)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs(spark, rows).repartition(5)).collect()))
    copies = {}
    for r in mixing.mix(docs(spark, rows)).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    want = {}
    for r in got:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    con = duckdb.connect()
    con.register("documents", docs(spark, rows).select("doc_id", "text", "source").toArrow())
    fields = ("doc_id", "size", "source_size", "target", "taken")
    assert sorted(map(repr, con.execute(f"SELECT {', '.join(fields)} FROM ({mixing.SQL})").fetchall())) == sorted(repr(tuple(r[f] for f in fields)) for r in got)
    assert copies == {d: c for d, c in want.items() if c} and mixing.mixed(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [])).count() == 0


# 10


def _toxic(spark, n=600):
    rng = random.Random(12)
    rows, marks = [], []
    for i in range(n):
        k = rng.choice([0, 0, 0, 0, 2, 3])
        words = prose(rng, 40).split()
        for at in rng.sample(range(len(words)), k):
            words[at] = rng.choice(INSULTS)
        rows.append((i, " ".join(words)))
        marks.append((i, int(k > 0)))
    return rows, marks


def test_toxicity(spark):
    rows, marks = _toxic(spark)
    labels = spark.createDataFrame(marks + [(5, None), (None, 1)], "doc_id long, toxic int")
    df = docs(spark, rows + [(1007, None), (1008, ""), (None, "idiot moron")])
    got = {r.doc_id: r for r in toxicity.scored(df, toxicity.train(df, labels)).collect()}
    held = [(i, y) for i, y in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].predicted == y for i, y in held) >= 0.93 * len(held)
    assert not any(got[i].predicted for i, y in held if not y) and got[1007].score == got[1008].score < 0.7
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in marks) and not got[None].held_out
    kept = {r.doc_id for r in toxicity.drop_toxic(docs(spark, rows), labels).collect()}
    assert kept == {i for i, _ in rows if not got[i].predicted}
    none = toxicity.scored(df, toxicity.train(df, labels.limit(0)))
    assert none.where("score > 0.01").count() == 0 and toxicity.scored(df.limit(0), toxicity.fit([], np.zeros(0))).count() == 0


def test_machine_learns_what_a_sum_cannot():
    rng = np.random.default_rng(13)
    a, b = rng.random(3000) < 0.5, rng.random(3000) < 0.5
    found = [np.unique(np.array([*([1] if x else []), *([2] if y else []), 3], np.uint32)) for x, y in zip(a, b, strict=True)]
    m = toxicity.fit(found, (a & b).astype(int))
    at = {int(h): i for i, h in enumerate(m.known)}
    score = lambda *t: float(toxicity._sigmoid(toxicity._raw(m.bias, m.weight, m.factor, np.array([at[x] for x in t if x in at], int), np.zeros(sum(x in at for x in t), int), 1)[0])[0])
    assert score(1, 2, 3) > 0.9 and max(score(1, 3), score(2, 3), score(3)) < 0.3


def test_machine_finds_rare_terms_and_rare_pairs():
    rng = np.random.default_rng(15)
    found, y = [], np.zeros(6000)
    for i in range(6000):
        words = {*range(100, 104), *rng.integers(200, 2200, 20).tolist()}
        if i < 20:  # a pure term in 0.3 % of the documents
            words.add(1)
        elif i < 60:  # toxic together only, and weak alone
            words |= {2, 3}
        elif i < 1200:
            words.add(2 if i % 2 else 3)
        y[i] = i < 60 or i > 5700
        found.append(np.array(sorted(words), np.uint32))
    m = toxicity.fit(found, y)
    at = {int(h): i for i, h in enumerate(m.known)}

    def score(*t):
        x = np.array([at[w] for w in (*t, 100, 101, 102, 103) if w in at], int)
        return float(toxicity._sigmoid(toxicity._raw(m.bias, m.weight, m.factor, x, np.zeros(len(x), int), 1)[0])[0])

    assert score(1) > 0.7 and score(2, 3) > 0.7 and max(score(2), score(3), score()) < 0.3


def test_machine_shares_weight_between_inflected_forms_and_scores_as_written():
    rng = random.Random(28)
    ends = ["en", "er", "es", "ung", "lich", "heit", "bar", "keit"]
    rows, y = [], []
    for i in range(3000):
        words = ["".join(rng.choice(["ka", "mo", "ri", "su", "te"]) for _ in range(3)) + rng.choice(ends) for _ in range(20)]
        toxic = i % 8 == 0
        if toxic:  # each form is rare, the stem isn't
            words += ["verf" + "".join(rng.choice(["ka", "mo", "ri", "su"]) for _ in range(2)) + rng.choice(ends) for _ in range(2)]
        rows.append(" ".join(words))
        y.append(int(toxic))
    m = toxicity.fit([toxicity.terms(x) for x in rows], np.array(y))
    fresh = ["kamori verfzuzuzu sutemo", "kamori zuverf sutemo", "", "verfamoen verfamoen"]
    scores = m.score(fresh)
    assert scores[0] > 0.7 and scores[1] < 0.3 and scores[2] < 0.3
    at = {int(h): i for i, h in enumerate(m.known)}
    for text, score in zip(fresh, scores, strict=True):
        t = [at[int(h)] for h in toxicity.terms(text) if int(h) in at]
        z = m.bias + sum(m.weight[i] for i in t) + sum(float(m.factor[i] @ m.factor[j]) for n, i in enumerate(t) for j in t[n + 1 :])
        assert score == pytest.approx(1 / (1 + math.exp(-z)))


# pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows, marks = _toxic(spark, 300)
    rng = random.Random(14)
    item = prose(rng, 30)
    long = [prose(rng, 150) for _ in range(5)]
    rows += [(1000 + i, t) for i, t in enumerate(long)] + [(1100 + i, t) for i, t in enumerate(long)] + [(1200, prose(rng, 100) + " " + item)]
    path = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "ab"[i % 2], len(t)) for i, t in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in marks], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "mixing sources", "token ids"]
    df, ids = spark.read.parquet(f"{path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        df = stage(spark, df, path)
        assert df.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
        df.write.parquet(f"{path}/stage{k}")
        df = spark.read.parquet(f"{path}/stage{k}")
        ids.append([r.doc_id for r in df.select("doc_id").collect()])
    y = dict(marks)
    assert not any(y.get(i) for i in ids[0]) or sum(y.get(i, 0) for i in ids[0]) <= 0.05 * sum(y.values())
    assert {i for i in range(1000, 1005)} <= set(ids[1]) and not {i for i in range(1100, 1105)} & set(ids[1]) and len(ids[1]) == len(set(ids[1]))
    assert set(ids[2]) == set(ids[1]) - {1200} and set(ids[3]) <= set(ids[2])
    out = corpus_pipeline.run(spark, path)
    assert sorted(r.doc_id for r in out.collect()) == sorted(ids[3]) and corpus_pipeline.ORACLE_SQL is None
