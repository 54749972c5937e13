import pytest
from layerwise.functions import bounds as B
from layerwise.plans import spec as P
from layerwise.sources import families as Fam


def test_repeated_word_and_matrices():
    g = P.permutation("w", [[1, 2, 3, 0], [1, 0, 2, 3]], [0, 0, 1, 2])
    assert sum(map(len, g.exact_layers(99))) == 12 and not g.inverse_closed()
    assert P.matrix("m", [([1, 1, 0, 1], 257)], [256, 2], 2, 1).successor((256, 2), 0) == (1, 2)
    big = (1 << 63) - 1
    assert P.matrix("m", [([2], 7)], [big], 1, 1).successor((big,), 0) == (5,)
    assert P.matrix("m", [([2], 0)], [big], 1, 1).successor((big,), 0) == (-2,)
    mixed = P.matrix("m", [([2], 5), ([2], 7)], [4], 1, 1)
    assert [mixed.successor((4,), i) for i in (0, 1)] == [(3,), (1,)]


def test_inverse_closure_needs_proof():
    big = (1 << 63) - 1
    assert not P.matrix("m", [([big], 3)], [1], 1, 1).inverse_closed()  # products wrap before the modulus
    assert P.matrix("m", [([-1], 0)], [1], 1, 1).inverse_closed()
    assert P.matrix("m", [([3], 4)], [1], 1, 1).inverse_closed()
    assert P.matrix("m", [([100], 101)], [1], 1, 1).inverse_closed()
    assert not P.matrix("m", [([100], 101)], [101], 1, 1).inverse_closed()
    assert Fam.coxeter(4).inverse_closed() and Fam.unitriangular(3, 6).inverse_closed() and Fam.cube().inverse_closed()


@pytest.mark.parametrize(("args", "code"), [((["x"], [0]), "GRAPH_NONINTEGER_SCALAR"), (([[0, 0]], [0, 1]), "GRAPH_PERMUTATION_GENERATOR"), (([], [0]), "GRAPH_GENERATORS"), (([[0]], [True]), "GRAPH_NONINTEGER_SCALAR"), (([[0]], [1 << 63]), "GRAPH_INT64_RANGE"), (([[0]], []), "GRAPH_PERMUTATION_SHAPE")])
def test_codes(args, code):
    with pytest.raises(P.GraphError) as e:
        P.permutation("g", *args)
    assert e.value.code == code


def test_document_round_trip_and_digest():
    g = Fam.coxeter(4)
    assert P.from_json(g.to_json()) == g
    with pytest.raises(P.GraphError):
        P.from_dict(g.to_dict() | {"extra": 1})
    renamed = P.permutation("other", g.generators, g.start, ["a", "b", "c"])
    assert renamed.digest() == g.digest()
    assert P.permutation("o", g.generators[::-1], g.start).digest() != g.digest()
    assert P.from_catalog("PermutationGroups.coxeter", 4) == g and Fam.from_label("s4") == g
    with pytest.raises(P.GraphError):
        P.from_catalog("nothing")


def test_manifest():
    m = {"schema": 1, "rows": 2, "cols": 2, "modulus": 4, "start": [1, 0, 0, 1], "generators": [[1, 1, 0, 1], [1, 3, 0, 1]], "inverse_map": [1, 0]}
    P.validate_manifest(m)
    for bad in ({"modulus": 1}, {"inverse_map": [0, 1]}, {"start": [2, 0, 0, 1]}, {"generators": [[1, 1, 0, 4], [1, 3, 0, 1]]}):
        with pytest.raises(P.GraphError):
            P.validate_manifest(m | bad)


def test_permutations():
    g = P.from_cycles(5, [(0, 1, 2)])
    assert P.compose(g, P.inverse(g)) == P.identity(5) and P.from_one_hot(P.one_hot(g), 5) == g
    with pytest.raises(P.GraphError):
        P.from_one_hot([1, 0, 1, 0], 2)


def test_bounds():
    assert B.mahonian(4) == [1, 3, 5, 6, 5, 3, 1] and max(B.mahonian(8)) == 3836
    assert B.stirling_layers(4) == [1, 6, 11, 6] and B.grassmann_layers(4, 2) == [1, 18, 16]
    assert B.lrx_order(15, 4) == 54_486_432_000 and B.lrx_order(14, 4) == 3_632_428_800
    assert [sum(r) for r in B.rank_distribution(5, 3)] == B.mahonian(5)
    assert B.product_spheres([1, 1, 1], [1, 2, 1]) == [1, 3, 4, 3, 1]
    assert B.orbit_bound(Fam.lrx(6, 4)) == 30 and B.orbit_bound(P.permutation("c", [[1, 2, 3, 0]], [0, 1, 0, 1])) == 2
    assert B.orbit_bound(Fam.unitriangular(3, 4)) == 64 and B.modular_bound(9, 256) is None
    assert Fam.as_lrx(P.permutation("x", Fam.lrx(5, 2).generators, [7, 3, 9, 4, 4])) == (5, 2, (7, 3, 9, 4)) and Fam.as_lrx(Fam.coxeter(4)) is None
