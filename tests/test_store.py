import hashlib

import pytest
from layerwise.operators import search as Q
from layerwise.operators import verify as V
from layerwise.plans import spec as P
from layerwise.sources import archive, dataset, store, tails
from layerwise.sources import families as Fam
from layerwise.streaming import feed


def test_dataset(spark, tmp_path):
    r = Q.layers(spark, Fam.coxeter(4), lane="array")
    path = str(tmp_path / "data")
    seed = bytes(range(16))
    dataset.write(dataset.tables(r, "run1", "g", seed, 2, 2, 2), path, "run1")
    assert not dataset.verify(spark, path).count()
    with pytest.raises(FileExistsError):
        dataset.write(dataset.tables(r, "run1", "g"), path, "run1")
    rows = dataset.read(spark, path, "states").collect()
    for x in rows:
        lanes = four_lanes(bytes(x.state), seed, b"GEMM_U8_P32X4/V1")
        assert bytes(x.hash128_le) == b"".join(v.to_bytes(4, "little") for v in lanes)
        top = (lanes[3] << 32 | lanes[2]) >> 61
        assert (x.logical_owner, x.shard, x.bucket, x.rank) == (top >> 2, top >> 1 & 1, top & 1, top >> 2)
    for rank in (0, 1):
        mine = sorted((x for x in rows if x.rank == rank), key=lambda x: x.rank_ordinal)
        assert [x.rank_ordinal for x in mine] == list(range(len(mine))) and [x.depth for x in mine] == sorted(x.depth for x in mine)
    dataset.write(dataset.tables(r, "run2", "g"), path, "run2")
    dataset.read(spark, path, "states").where("run_id = 'run2' AND depth = 2").drop("run_id").write.mode("append").parquet(f"{path}/states/run_id=run2")
    assert {x.error for x in dataset.verify(spark, path).collect()} == {"DUPLICATE_STATE", "DATASET_COUNTS", "PARQUET_MANIFEST_MISMATCH"}
    with pytest.raises(ValueError, match="RUN_ID_PATH"):
        dataset.tables(r, "../x", "g")


def four_lanes(state, seed, domain):
    """The four-lane hash of some bytes, word by word."""
    raw = hashlib.shake_256(domain + b"\0" + len(state).to_bytes(4, "little") + seed).digest(1 << 14)
    words = (w for w in (int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)) if w < 4294967291)
    a = [[next(words) for _ in range(4)] for _ in state]
    return [(b + sum(x * row[j] for x, row in zip(state, a, strict=True))) % 4294967291 for j, b in enumerate([next(words) for _ in range(4)])]


def test_four_lane_hash_passes_over_large_words(spark):
    # words from the prime on are rare, so a small prime shows that they are passed over and not reduced
    from layerwise.functions import states as S

    a, b = S.hash_terms(16, bytes(16), b"domain")
    assert len(a) == 16 and len(b) == 4 and all(w < S.PRIME for row in [*a, b] for w in row)
    for state in (bytes(16), bytes(range(16)), bytes([255] * 16)):
        df = spark.createDataFrame([(list(state),)], "state array<bigint>")
        got = df.select(*S.modular_hash("state", 16, b"0123456789abcdef", b"another")).first()
        assert list(got) == four_lanes(state, b"0123456789abcdef", b"another")


def test_tail_and_parts(spark, tmp_path):
    r, folder = Q.layers(spark, Fam.coxeter(3), lane="array"), str(tmp_path / "tail")
    rows = r.layer(1).selectExpr("unhex(array_join(transform(state, x -> lpad(hex(x), 2, '0')), '')) AS state")
    with pytest.raises(ValueError, match="TAIL_DEPTH"):
        tails.commit_layer(rows, folder, 1, 2, 3, 0.0)
    tails.commit_layer(rows, folder, 0, 2, 3, 0.0)
    for k in (0, 1):
        spark.createDataFrame([(0, bytes([k, 1, 2]))], "ordinal long, state binary").write.parquet(str(tmp_path / f"part{k}"))
    parts = [(str(tmp_path / f"part{k}"), 1) for k in (0, 1)]
    with pytest.raises(ValueError, match="TAIL_COUNT"):
        tails.adopt_parts(spark, [parts[0], (parts[1][0], 2)], folder, 1, 3, 0.0)
    assert (tmp_path / "part0").exists()  # nothing moves before all is checked
    tails.adopt_parts(spark, parts, folder, 1, 3, 0.0)
    got = sorted((x.depth, x.ordinal, bytes(x.state)) for x in tails.read_layers(spark, folder).collect())
    assert got == [(0, 0, b"\0\2\1"), (0, 1, b"\1\0\2"), (1, 0, b"\0\1\2"), (1, 1, b"\1\1\2")]


def test_partitioned_states_and_retention(spark, tmp_path):
    r = Q.layers(spark, Fam.coxeter(4), lane="array")
    store.write_states(r, str(tmp_path / "s"))
    assert store.read_states(spark, str(tmp_path / "s"), [1, 2]).count() == 8
    layers = spark.createDataFrame([(d, n, n * 10) for d, n in enumerate(r.sizes)], "depth int, states long, bytes long")
    keep = lambda *a, **k: sorted(x.depth for x in store.retained(layers, *a, **k).collect())
    assert keep("last", 2) == [5, 6] and keep("small") == [5, 6] and keep("complete_bytes", 3, 100) == [3, 4, 5, 6] and keep("complete_bytes", 3, 10) == [4, 5, 6]
    snap = store.snapshot(store.with_ordinals(r.states()), layers, False, 8, 8 * 6).collect()
    assert sorted((x.depth, x.ordinal) for x in snap) == [(4, 3), (4, 4), (5, 0), (5, 1), (5, 2), (6, 0)]
    packed = store.packed_states(spark.createDataFrame([([1, 2, 3, 15] * 5,)], "state array<bigint>"), 4).first().state
    assert bytes(packed) == sum(v << 4 * i for i, v in enumerate([1, 2, 3, 15] * 5)).to_bytes(16, "little")


def test_archive(spark, tmp_path):
    layers = [[b"ab"], [b"cd", b"ef"], [b"gh"]]
    raw = archive.encode(layers, 2, b"c" * 32, batch=1)
    assert archive.decode(raw) == ((b"c" * 32).hex(), list(enumerate(layers)))
    (tmp_path / "a.bin").write_bytes(raw)
    rows = archive.read_archives(spark, str(tmp_path / "a.bin")).collect()
    assert sorted((r.depth, r.ordinal, bytes(r.state)) for r in rows) == [(d, i, s) for d, x in enumerate(layers) for i, s in enumerate(x)]
    for bad, code in ((raw[:-1], "ARCHIVE_TRUNCATED"), (raw[:200] + bytes([raw[200] ^ 1]) + raw[201:], "ARCHIVE"), (raw[:20], "ARCHIVE_HEADER")):
        with pytest.raises(archive.ArchiveError, match=code):
            archive.decode(bad)
    assert archive.decode(raw[:-100], whole=False)[1] == list(enumerate(layers))
    sampled = archive.encode([x[:1] for x in layers], 2, b"c" * 32, b"LAYERAS2", last=[b"xy", b"zz"])
    assert archive.decode(sampled)[1] == [(0, [b"ab"]), (1, [b"cd"]), (2, [b"xy", b"zz"])]
    # a replacement that isn't committed leaves the layer as it was
    assert archive.decode(sampled[: -112 - 112], whole=False)[1] == [(0, [b"ab"]), (1, [b"cd"]), (2, [b"gh"])]


def test_ranks_and_ledgers(spark):
    ranks = spark.createDataFrame([(0, "c", [1, 1, 0]), (1, "c", [0, 2, 2])], "rank int, config_digest string, layer_counts array<bigint>")
    assert [r.states for r in store.combine_ranks(ranks).orderBy("depth").collect()] == [1, 3, 2]
    with pytest.raises(ValueError, match="RANK_SET"):
        store.combine_ranks(ranks.where("rank = 1"))
    want = spark.createDataFrame([(0, 1), (1, 3), (2, 3)], "depth int, states long")
    assert [r.depth for r in V.compare_layers(store.combine_ranks(ranks), want).collect()] == [2]
    cases = spark.createDataFrame([(4, 1, None), (5, 1, "RESOURCE_MEMORY"), (6, 1, None), (6, 2, "out of memory"), (5, 2, "bug")], "n int, r int, reason string")
    assert {(x.n, x.r) for x in V.pruned(cases).where("skip").collect()} == {(6, 1)}
    status = lambda *s: V.roll_up(spark.createDataFrame([(x,) for x in s], "status string")).first().status
    assert status("VERIFIED_LAYER_COUNTS", "FAILED", "x") == "FAILED" and status("VERIFIED_LAYER_COUNTS") == "VERIFIED_LAYER_COUNTS" and status("VERIFIED_LAYER_COUNTS", "x") == "NOT_VALIDATED"


def test_states_against_another_set(spark):
    a = Q.layers(spark, Fam.coxeter(3), lane="array").states()
    b = Q.layers(spark, P.permutation("o", Fam.coxeter(3).generators[::-1], range(3)), lane="driver").states()
    assert not V.compare_states(a, b).count() and V.compare_states(a.where("depth < 2"), b).count() == 3 and not V.duplicate_states(a).count()


def test_feed(spark, tmp_path):
    folder, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    r = Q.layers(spark, Fam.coxeter(3), lane="array")
    for d in (0, 1):
        feed.publish(r.layer(d), folder, d, r.sizes[d])
    r.layer(2).write.parquet(f"{folder}/layers/depth=2")  # without a commit it isn't there
    assert {x.depth: x.states for x in feed.consume(spark, folder, target, mark).collect()} == {0: 1, 1: 2}
    feed.publish(r.layer(2), folder, 2, r.sizes[2])
    assert {x.depth: x.states for x in feed.consume(spark, folder, target, mark).collect()} == {0: 1, 1: 2, 2: 2}


def test_cohorts():
    assert store.cohorts([("a", 8, 5), ("b", 8, 5), ("c", 8, 1), ("d", 16, 1), ("e", 16, 99)], 20, 10) == [["a", "b"], ["c"], ["d"], ["e"]]
    assert store.cohorts([(str(i), 8, 0) for i in range(5)], 2) == [["0", "1"], ["2", "3"], ["4"]] and store.cohorts([]) == []


def test_configuration_model_and_puzzles(spark):
    degrees = spark.range(60).selectExpr("id AS vertex", "3 AS degree")
    edges = Fam.configuration(degrees, 4)
    rows = {(r.src, r.dst) for r in edges.collect()}
    assert rows == {(r.src, r.dst) for r in Fam.configuration(degrees.repartition(3), 4).collect()} and all((b, a) in rows and a != b for a, b in rows)
    per = [sum(a == v for a, _ in rows) for v in range(60)]
    assert max(per) <= 3 and sum(per) >= 150
    g = Fam.from_puzzle('{"name": "p", "central_state": [0, 1, 2], "generators": {"r": [1, 2, 0], "l": [2, 0, 1]}}')
    assert g.names == ("r", "l") and list(map(len, g.exact_layers(9))) == [1, 2]
    with pytest.raises(P.GraphError):
        Fam.from_puzzle('{"central_state": [0, 1, 2], "generators": {"r": [1, 2, 0]}}')


def test_footers(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "states").mkdir()
    name = lambda rank, part: f"states/x-rank-{rank:05d}-part-{part:08d}.parquet"
    for rank, part, n in ((0, 0, 3), (0, 1, 2), (1, 0, 4)):
        pq.write_table(pa.table({"depth": pa.array(range(n), pa.int32())}), tmp_path / name(rank, part))
    pq.write_table(pa.table({"depth": pa.array([1], pa.int64())}), tmp_path / name(1, 2))
    files = lambda *f: spark.createDataFrame(f, "path string, rows long")
    audit = lambda df, world=2, counts=(1, 8): {r.error for r in store.audit_footers(df, str(tmp_path), world, list(counts)).collect()}
    good = [(name(0, 0), 3), (name(0, 1), 2), (name(1, 0), 4)]
    assert audit(files(*good)) == set() == audit(files(*[(p, None) for p, _ in good]))
    assert audit(files(*good), 1, (9, 1)) == {"FOOTER_RANK", "FOOTER_ROW_TOTAL"}
    assert audit(files((name(0, 0), 4), *good[1:])) == {"FOOTER_FILE_ROWS"}
    assert audit(files(*good, (name(1, 2), None)), counts=(10,)) == {"FOOTER_FILE_ROWS_PARTIAL", "FOOTER_SCHEMA", "FOOTER_PART_SEQUENCE"}
    assert audit(files(*good, (name(0, 0), 3)), counts=(12,)) == {"FOOTER_DUPLICATE_PART"}
    assert audit(files(*good, ("states/none.parquet", 1))) == {"FOOTER_PATH", "FOOTER_UNREADABLE"}
    assert audit(files(), counts=()) == set()


def test_layer_digests(spark):
    import hashlib

    rows = [(d, r, o, f"{d}{r}{o}".encode(), bytes([o]) * 16) for d in range(3) for r in (0, 258) for o in range(40)]
    df = spark.createDataFrame(rows, "depth int, rank int, rank_ordinal long, state binary, hash128_le binary")
    for hashes in (None, "hash128_le"):
        want = {d: hashlib.sha256(b"".join(r.to_bytes(4, "little") + s + (h if hashes else b"") for e, r, _, s, h in sorted(rows) if e == d)).hexdigest() for d in range(3)}
        assert {x.depth: x.content_sha256 for x in store.layer_digests(df, hashes).collect()} == want
    assert store.layer_digests(df.where("false")).count() == 0 == store.layer_digests(df.withColumn("state", df.state.substr(1, 0)).where("rank IS NULL")).count()


def test_selected_totals(spark, tmp_path):
    """Sums of places and keys beyond 64 bits are whole; others stay 64-bit integers, as in the SQL."""
    from layerwise.plans import catalog

    for first, kind in ((1, "bigint"), (10**18 + 1, "decimal(38,0)")):
        keys = [first + 2 * i for i in range(300) if (first + 2 * i) % 50]
        folder = f"{tmp_path}/{first}"
        spark.createDataFrame([(k, k % 7) for k in keys], "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
        got = catalog.queries()["snk7_so3_selected_tail"](spark, folder)
        order = sorted(keys, key=lambda k: (k % 7 % 4, k))
        want = [(2, whole, n, n - 1, sum(i * k for i, k in enumerate(order[:n]))) for whole, n in ((False, 200), (True, len(keys)))]
        assert sorted(map(tuple, got.collect())) == want and dict(got.dtypes)["total"] == kind
