"""Counts and bounds in closed form. Covers MA1-MA9 (MA9 as partition advice), FL17."""

from __future__ import annotations

from collections import Counter
from math import comb, exp, factorial, lcm, prod

from ..plans.spec import GraphSpec


def mahonian(n: int) -> list[int]:
    """Orderings of n symbols by inversions: the layers of adjacent transpositions."""
    out = [1]
    for k in range(2, n + 1):
        out = [sum(out[max(0, i - k + 1) : i + 1]) for i in range(len(out) + k - 1)]
    return out


def live_window(sizes: list[int]) -> int:
    """Most states in three layers in a row."""
    return max(sum(sizes[max(0, i - 2) : i + 1]) for i in range(len(sizes)))


def multinomial(counts) -> int:
    return factorial(sum(counts)) // prod(map(factorial, counts))


def lrx_order(n: int, r: int) -> int:
    return factorial(n) // factorial(r)


def modular_bound(cells: int, modulus: int) -> int | None:
    """modulus ** cells, or None above 2**31 - 2."""
    size = modulus**cells
    return size if size <= (1 << 31) - 2 else None


def position_components(spec: GraphSpec) -> list[list[int]]:
    """Places that the generators move into each other."""
    parent = list(range(len(spec.start)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for g in spec.generators:
        for i, x in enumerate(g):
            parent[root(i)] = root(x)
    by: dict[int, list[int]] = {}
    for i in range(len(parent)):
        by.setdefault(root(i), []).append(i)
    return list(by.values())


def orbit_bounds(spec: GraphSpec) -> dict[str, int]:
    """Upper bounds of the orbit by kind."""
    out = {"declared": spec.bound} if spec.bound else {}
    if spec.kind == "permutation":
        out["multinomial"] = multinomial(Counter(spec.start).values())
        out["components"] = prod(multinomial(Counter(spec.start[i] for i in c).values()) for c in position_components(spec))
        if len(spec.generators) == 1:
            out["cyclic"] = _period(spec)
    else:
        moduli = {q for _, q in spec.generators}
        if len(moduli) == 1 and (q := moduli.pop()):
            free = all(0 <= v < q for v in spec.start)
            out["matrix"] = q ** len(spec.start) + (0 if free else 1)
    return out


def _period(spec: GraphSpec) -> int:
    """Steps after which one permutation brings the start back: the least common multiple of its cycles' label periods."""
    g, seen, out = spec.generators[0], set(), 1
    for i in range(len(g)):
        if i in seen:
            continue
        cycle, at = [], i
        while at not in seen:
            seen.add(at)
            cycle.append(spec.start[at])
            at = g[at]
        n = len(cycle)
        out = lcm(out, next(p for p in range(1, n + 1) if n % p == 0 and all(cycle[k] == cycle[(k + p) % n] for k in range(n))))
    return out


def orbit_bound(spec: GraphSpec) -> int | None:
    return min(orbit_bounds(spec).values(), default=None)


def hamming_layers(d: int, q: int) -> list[int]:
    return [comb(d, k) * (q - 1) ** k for k in range(d + 1)]


def johnson_layers(n: int, k: int) -> list[int]:
    return [comb(k, i) * comb(n - k, i) for i in range(min(k, n - k) + 1)]


def gaussian(n: int, k: int, q: int) -> int:
    return prod(q ** (n - i) - 1 for i in range(k)) // prod(q ** (i + 1) - 1 for i in range(k))


def grassmann_layers(n: int, k: int, q: int = 2) -> list[int]:
    return [q ** (i * i) * gaussian(k, i, q) * gaussian(n - k, i, q) for i in range(min(k, n - k) + 1)]


def stirling_layers(n: int) -> list[int]:
    """Orderings by n minus cycles: the layers of all transpositions."""
    row = [1]
    for k in range(1, n + 1):
        row = [(row[i - 1] if i else 0) + (k - 1) * (row[i] if i < len(row) else 0) for i in range(k + 1)]
    return [row[n - d] for d in range(n)]


def rank_distribution(n: int, world: int) -> list[list[int]]:
    """counts[depth][rank mod world] of adjacent transpositions, by the digits of the Lehmer code."""
    table = {(0, 0): 1}
    for i in range(n):
        place, new = factorial(n - 1 - i), Counter()
        for (d, r), c in table.items():
            for digit in range(n - i):
                new[d + digit, (r + digit * place) % world] += c
        table = new
    return [[table.get((d, r), 0) for r in range(world)] for d in range(n * (n - 1) // 2 + 1)]


def product_spheres(a: list[int], b: list[int]) -> list[int]:
    """Sphere sizes of a Cartesian product: their convolution."""
    out = [0] * (len(a) + len(b) - 1)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            out[i + j] += x * y
    return out


def giant_fraction(degree: float, steps: int = 500) -> float:
    """The fixed point of s = 1 - exp(-degree * s)."""
    s = 1.0
    for _ in range(steps):
        s = 1 - exp(-degree * s)
    return s


def partitions(states: int, per_partition: int = 400_000, most: int = 100_000) -> int:
    """Advice for spark.sql.shuffle.partitions from a layer's bound."""
    return max(1, min(most, -(-states // per_partition)))
