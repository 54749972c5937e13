"""Graph definitions: permutation and matrix actions, their validation, identity and inverse closure.

Covers SRC1-SRC4, SNK12, PR1, PR2 (one state), PR9-PR11, FL1, FL2, D1-D5.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from math import gcd

LOW, HIGH, WRAP = -(1 << 63), (1 << 63) - 1, 1 << 64


class GraphError(ValueError):
    """``code`` is one of the stable GRAPH_*, MATRIX_*, LRX_*, MACRO_* or ORACLE_* codes."""

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code


def _need(fine: bool, code: str) -> None:
    if not fine:
        raise GraphError(code)


def _integers(values: Iterable, code: str = "GRAPH_INT64_RANGE") -> list[int]:
    out = list(values)
    _need(all(type(v) is int for v in out), "GRAPH_NONINTEGER_SCALAR")
    _need(all(LOW <= v <= HIGH for v in out), code)
    return out


def wrapped(v: int) -> int:
    """Two's complement of 64 bits."""
    return (v - LOW) % WRAP + LOW


@dataclass(frozen=True)
class GraphSpec:
    """A Schreier graph: states are integer vectors, edges are generator actions on the start's orbit."""

    name: str
    kind: str  # permutation or matrix
    generators: tuple  # permutations, or (flat matrix, modulus) pairs
    start: tuple[int, ...]
    names: tuple[str, ...] = ()
    bound: int | None = None  # declared most states
    rows: int = 0
    cols: int = 1
    meta: dict = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        n = len(self.generators)
        object.__setattr__(self, "names", tuple(self.names) or tuple(str(i) for i in range(n)))
        _need(isinstance(self.name, str), "GRAPH_NAME")
        _need(n > 0, "GRAPH_GENERATORS")
        _need(len(self.names) == n and all(isinstance(x, str) for x in self.names), "GRAPH_GENERATOR_NAMES")
        _need(self.bound is None or type(self.bound) is int and 1 <= self.bound < WRAP, "GRAPH_ORBIT_BOUND")
        _integers(self.start)
        if self.kind == "permutation":
            _need(0 < len(self.start) < 1 << 32, "GRAPH_PERMUTATION_SHAPE")
            every = list(range(len(self.start)))
            for g in self.generators:
                _need(sorted(_integers(g)) == every, "GRAPH_PERMUTATION_GENERATOR")
        elif self.kind == "matrix":
            _need(self.rows > 0 and self.cols > 0 and len(self.start) == self.rows * self.cols, "GRAPH_MATRIX_SHAPE")
            for flat, modulus in self.generators:
                _need(len(_integers(flat)) == self.rows**2, "GRAPH_MATRIX_GENERATOR")
                _need(type(modulus) is int and (modulus == 0 or 2 <= modulus <= 1 << 31), "GRAPH_MATRIX_MODULUS")
        else:
            raise GraphError("GRAPH_ACTION_KIND")

    # identity

    def action(self) -> dict:
        if self.kind == "permutation":
            return {"kind": "permutation", "degree": len(self.start), "generators": [list(g) for g in self.generators]}
        return {"kind": "matrix", "rows": self.rows, "cols": self.cols, "generators": [{"matrix": list(m), "modulo": q} for m, q in self.generators]}

    def to_dict(self) -> dict:
        return {"schema": 2, "name": self.name, "generator_names": list(self.names), "action": self.action(), "start": list(self.start), "expected_max_unique_states": self.bound}

    def to_json(self) -> str:
        """Canonical JSON: sorted keys, no spaces, ASCII."""
        return json.dumps(self.to_dict(), sort_keys=True, separators=(",", ":"), ensure_ascii=True)

    def digest(self) -> str:
        """SHA-256 of schema, action and start; names and bounds don't count, the order of generators does."""
        body = {"schema": 2, "action": self.action(), "start": list(self.start)}
        return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()

    # one state

    def successor(self, state: tuple[int, ...], move: int) -> tuple[int, ...]:
        _need(len(state) == len(self.start) and 0 <= move < len(self.generators), "GRAPH_SUCCESSOR_ARGUMENT")
        if self.kind == "permutation":
            return tuple(state[i] for i in self.generators[move])
        flat, q = self.generators[move]
        n, m = self.rows, self.cols
        dots = (wrapped(sum(flat[r * n + k] * state[k * m + c] for k in range(n))) for r in range(n) for c in range(m))
        return tuple(d % q if q else d for d in dots)

    def inverse_closed(self) -> bool:
        """True only if proved: then a layer needs the two layers before it and no other history."""
        if self.kind == "permutation":
            every = {tuple(g) for g in self.generators}
            return all(inverse(g) in every for g in every)
        moduli = {q for _, q in self.generators}
        if len(moduli) != 1:
            return False
        q, n = moduli.pop(), self.rows
        size = q or WRAP
        if q and not all(0 <= v < q for v in self.start):
            return False
        if q and q & (q - 1):
            # products that wrap before the modulus is taken are not products modulo q
            reach = max(max(map(abs, flat)) for flat, _ in self.generators) * (q - 1) * n
            if reach > HIGH:
                return False
        unit = [int(r == c) % size for r in range(n) for c in range(n)]

        def product(a, b):
            return [sum(a[r * n + k] * b[k * n + c] for k in range(n)) % size for r in range(n) for c in range(n)]

        return all(any(product(a, b) == unit and product(b, a) == unit for b, _ in self.generators) for a, _ in self.generators)

    def exact_layers(self, maximum_states: int) -> list[list[tuple[int, ...]]]:
        """The orbit by layers, each sorted, on the driver. The bound is checked after each whole layer."""
        _need(maximum_states >= 1, "ORACLE_CAPACITY")
        layers, seen = [[self.start]], {self.start}
        while layers[-1]:
            new = {self.successor(s, g) for s in layers[-1] for g in range(len(self.generators))} - seen
            seen |= new
            _need(len(seen) <= maximum_states, "ORACLE_CAPACITY")
            layers.append(sorted(new))
        return layers[:-1]


def permutation(name: str, generators, start, names=(), bound: int | None = None) -> GraphSpec:
    return GraphSpec(name, "permutation", tuple(tuple(g) for g in generators), tuple(start), tuple(names), bound)


def matrix(name: str, generators, start, rows: int, cols: int, names=(), bound: int | None = None) -> GraphSpec:
    return GraphSpec(name, "matrix", tuple((tuple(m), q) for m, q in generators), tuple(start), tuple(names), bound, rows, cols)


def from_dict(data: dict) -> GraphSpec:
    """A closed document: unknown or missing keys are refused."""
    keys = {"schema", "name", "generator_names", "action", "start", "expected_max_unique_states"}
    _need(isinstance(data, dict) and set(data) == keys and data["schema"] == 2, "GRAPH_SCHEMA")
    a = data["action"]
    _need(isinstance(a, dict), "GRAPH_ACTION_KIND")
    if a.get("kind") == "permutation":
        _need(set(a) == {"kind", "degree", "generators"} and a["degree"] == len(data["start"]), "GRAPH_PERMUTATION_SHAPE")
        return permutation(data["name"], a["generators"], data["start"], data["generator_names"], data["expected_max_unique_states"])
    _need(a.get("kind") == "matrix", "GRAPH_ACTION_KIND")
    _need(set(a) == {"kind", "rows", "cols", "generators"} and type(a["rows"]) is int and type(a["cols"]) is int, "GRAPH_MATRIX_SHAPE")
    _need(all(isinstance(g, dict) and set(g) == {"matrix", "modulo"} for g in a["generators"]), "GRAPH_MATRIX_GENERATOR")
    return matrix(data["name"], [(g["matrix"], g["modulo"]) for g in a["generators"]], data["start"], a["rows"], a["cols"], data["generator_names"], data["expected_max_unique_states"])


def from_json(text: str) -> GraphSpec:
    return from_dict(json.loads(text))


def labels(values) -> list[int]:
    """Whole numbers of any nesting, as integers of 64 bits; fractions, truth values and text are refused."""
    if hasattr(values, "tolist"):
        values = values.tolist()
    if isinstance(values, list | tuple | range):
        return [v for x in values for v in labels(x)]
    _need(not isinstance(values, bool | str | bytes), "GRAPH_NONINTEGER_SCALAR")
    whole = isinstance(values, float) and values.is_integer()  # neither infinite nor NaN
    _need(whole or hasattr(values, "__index__"), "GRAPH_NONINTEGER_SCALAR")
    return _integers([int(values)])


def from_object(graph) -> GraphSpec:
    """Any object with generators_type, central_state, generators and generator_names (duck typing), or one that holds
    such as ``definition`` or ``graph_def``."""
    if not hasattr(graph, "generators_type"):
        graph = getattr(graph, "definition", getattr(graph, "graph_def", graph))
    kind = graph.generators_type
    kind = str(getattr(kind, "name", kind)).rpartition(".")[2].lower()
    names, start, name = tuple(getattr(graph, "generator_names", ())), labels(graph.central_state), getattr(graph, "name", "")
    if "perm" in kind:
        return permutation(name, [labels(g) for g in graph.generators_permutations], start, names)
    _need("matri" in kind, "GRAPH_ACTION_KIND")
    found = [(labels(g.matrix), *labels(g.modulo)) for g in graph.generators_matrices]
    rows = len(graph.generators_matrices[0].matrix)
    _need(rows > 0 and len(start) % rows == 0, "GRAPH_MATRIX_SHAPE")
    return matrix(name, found, start, rows, len(start) // rows, names)


_CATALOG: dict[str, Callable[..., GraphSpec]] = {}


def catalogued(path: str):
    def add(build):
        _CATALOG[path] = build
        return build

    return add


def from_catalog(path: str, *args, **kwargs) -> GraphSpec:
    _need(path in _CATALOG, "GRAPH_CATALOG")
    return _CATALOG[path](*args, **kwargs)


# permutations


def identity(n: int) -> tuple[int, ...]:
    return tuple(range(n))


def inverse(g) -> tuple[int, ...]:
    out = [0] * len(g)
    for i, x in enumerate(g):
        out[x] = i
    return tuple(out)


def compose(g, h) -> tuple[int, ...]:
    """First g, then h: state -> state[g] -> state[g][h]."""
    return tuple(g[i] for i in h)


def from_cycles(n: int, cycles) -> tuple[int, ...]:
    out = list(range(n))
    for cycle in cycles:
        for a, b in zip(cycle, [*cycle[1:], cycle[0]], strict=True):
            out[a] = b
    return tuple(out)


def one_hot(g) -> tuple[int, ...]:
    """The flat matrix with a one at (row, g[row])."""
    n = len(g)
    return tuple(int(c == g[r]) for r in range(n) for c in range(n))


def from_one_hot(flat, n: int) -> tuple[int, ...]:
    rows = [list(flat[r * n : (r + 1) * n]) for r in range(n)]
    _need(all(sorted(r) == [0] * (n - 1) + [1] for r in rows), "NOT_PERMUTATION_MATRIX")
    out = tuple(r.index(1) for r in rows)
    _need(len(set(out)) == n, "NOT_PERMUTATION_MATRIX")
    return out


def validate_manifest(m: dict) -> None:
    """Matrix manifest of schema 1: shapes, bounds, an involutive inverse map and a start that is invertible modulo every
    prime factor of the modulus."""
    _need(m.get("schema") == 1, "MATRIX_SCHEMA")
    n, q = m["rows"], m["modulus"]
    _need(type(n) is int and n > 0 and m["cols"] == n, "MATRIX_SHAPE")
    _need(type(q) is int and 2 <= q <= 256, "MATRIX_MODULUS")
    _need(n * (q - 1) ** 2 < 1 << 32, "MATRIX_ACCUMULATOR_BOUND")
    fine = lambda flat: len(flat) == n * n and all(type(v) is int and 0 <= v < q for v in flat)
    _need(fine(m["start"]), "MATRIX_START")
    _need(len(m["generators"]) > 0 and all(fine(g) for g in m["generators"]), "MATRIX_GENERATOR")
    inv, k = m["inverse_map"], len(m["generators"])
    _need(len(inv) == k and all(0 <= i < k for i in inv) and all(inv[inv[i]] == i for i in range(k)), "MATRIX_INVERSE_MAP")
    for i, j in enumerate(inv):
        a, b = m["generators"][i], m["generators"][j]
        _need([sum(a[r * n + x] * b[x * n + c] for x in range(n)) % q for r in range(n) for c in range(n)] == [int(r == c) for r in range(n) for c in range(n)], "MATRIX_INVERSE_MAP")
    _need(gcd(determinant(m["start"], n), q) == 1, "MATRIX_START_SINGULAR")


def determinant(flat, n: int) -> int:
    """Exact, by fraction-free elimination."""
    a, sign, last = [list(flat[r * n : (r + 1) * n]) for r in range(n)], 1, 1
    for k in range(n - 1):
        pivot = next((r for r in range(k, n) if a[r][k]), None)
        if pivot is None:
            return 0
        if pivot != k:
            a[k], a[pivot], sign = a[pivot], a[k], -sign
        for r in range(k + 1, n):
            for c in range(k + 1, n):
                a[r][c] = (a[r][c] * a[k][k] - a[r][k] * a[k][c]) // last
        last = a[k][k]
    return sign * a[-1][-1]
