"""Column expressions on states: successors, packing, ranks, hashes, owners and closed-form metrics.

States are array<bigint>, or one bigint of ``bits`` per element where that fits (lane L1). Everything stays inside
Catalyst expressions. Covers PR1-PR4, PR6-PR8, PR12-PR27.
"""

from __future__ import annotations

import hashlib
from math import factorial

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.spec import GraphError, GraphSpec


UNROLLED = 256  # elements of all children that are written out; more would outgrow a generated method


def bits_of(spec: GraphSpec) -> int | None:
    """Bits per element of the packed lane, or None if a state doesn't fit into 63 bits or is no permutation action."""
    if spec.kind != "permutation" or min(spec.start) < 0:
        return None
    b = max(1, max(spec.start).bit_length())
    return b if b * len(spec.start) <= 63 else None


def packed(values, bits: int) -> int:
    return sum(v << bits * i for i, v in enumerate(values))


def pack(state: str, n: int, bits: int) -> Column:
    return F.expr(" | ".join(f"shiftleft({state}[{i}], {bits * i})" for i in range(n)))


def unpack(key: str, n: int, bits: int) -> Column:
    return F.expr("array(" + ", ".join(f"shiftrightunsigned({key}, {bits * i}) & {(1 << bits) - 1}L" for i in range(n)) + ")")


def packed_moves(g, bits: int) -> list[tuple[int, int]]:
    """(distance, mask): fields that move by the same distance move together under one mask."""
    by: dict[int, int] = {}
    for to, source in enumerate(g):
        by[to - source] = by.get(to - source, 0) | ((1 << bits) - 1) << bits * source
    return sorted(by.items())


def packed_child(key: str, g, bits: int) -> Column:
    parts = []
    for d, mask in packed_moves(g, bits):
        field = f"({key} & {mask}L)"
        parts.append(f"shiftleft({field}, {bits * d})" if d > 0 else f"shiftrightunsigned({field}, {-bits * d})" if d < 0 else field)
    return F.expr(" | ".join(parts))


def child(spec: GraphSpec, move: int, state: str = "state") -> Column:
    """Array form. Matrix products wrap at 64 bits before the modulus, so frames with them must be built with ANSI mode
    off (see plans.session.wrapping); a literal gather per permutation."""
    if spec.kind == "permutation":
        if len(spec.start) * len(spec.generators) > UNROLLED:
            return F.expr(f"transform(array({', '.join(map(str, spec.generators[move]))}), i -> {state}[i])")
        return F.expr("array(" + ", ".join(f"{state}[{i}]" for i in spec.generators[move]) + ")")
    flat, q = spec.generators[move]
    n, m = spec.rows, spec.cols
    dots = []
    for r in range(n):
        for c in range(m):
            terms = [f"{flat[r * n + k]}L * {state}[{k * m + c}]" if flat[r * n + k] != 1 else f"{state}[{k * m + c}]" for k in range(n) if flat[r * n + k]]
            dot = " + ".join(terms) or "0L"
            dots.append(f"pmod({dot}, {q}L)" if q else f"({dot})")
    return F.expr(f"array({', '.join(dots)})")


def children(spec: GraphSpec, state: str = "state", bits: int | None = None) -> Column:
    """All children in the order of the generators."""
    return F.array(*[packed_child(state, g, bits) if bits else child(spec, i, state) for i, g in enumerate(spec.generators)])


def rotate_left(state: str) -> Column:
    return F.expr(f"concat(slice({state}, 2, size({state}) - 1), slice({state}, 1, 1))")


def rotate_right(state: str) -> Column:
    return F.expr(f"concat(slice({state}, -1, 1), slice({state}, 1, size({state}) - 1))")


def swap_first(state: str) -> Column:
    return F.expr(f"concat(slice({state}, 2, 1), slice({state}, 1, 1), slice({state}, 3, size({state})))")


def composed(g: str, h: str) -> Column:
    return F.expr(f"transform({h}, i -> {g}[int(i)])")


def inverted(g: str) -> Column:
    return F.expr(f"transform(sequence(0, size({g}) - 1), i -> bigint(array_position({g}, i) - 1))")


def lehmer_rank(state: str, n: int) -> Column:
    """Place among the orderings of n distinct symbols, in lexicographic order; n up to 20."""
    smaller = [" + ".join([f"int({state}[{j}] < {state}[{i}])" for j in range(i + 1, n)]) or "0" for i in range(n)]
    return F.expr(" + ".join(f"({s}) * {factorial(n - 1 - i)}L" for i, s in enumerate(smaller)))


def multiset_rank(state: str, counts) -> Column:
    """Place among the words with ``counts`` of each symbol, in lexicographic order."""
    n, k = sum(counts), len(counts)
    if factorial(n) >= 1 << 63:
        raise GraphError("BITMAP_STATE_LENGTH")
    left = "array(" + ", ".join(f"{c}L" for c in counts) + ")"
    ways = "array(" + ", ".join(f"{factorial(i)}L" for i in range(n + 1)) + ")"
    words = f"{ways}[int(aggregate(a.left, 0L, (s, x) -> s + x)) - 1] div aggregate(zip_with(a.left, sequence(0, {k - 1}), (x, i) -> {ways}[int(IF(i = c, x - 1, x))]), 1L, (s, x) -> s * x)"
    step = f"named_struct('left', zip_with(a.left, sequence(0, {k - 1}), (x, i) -> IF(i = v, x - 1, x)), 'rank', a.rank + aggregate(filter(sequence(0, {k - 1}), c -> c < v AND a.left[c] > 0), 0L, (s, c) -> s + {words}))"
    return F.expr(f"aggregate({state}, named_struct('left', {left}, 'rank', 0L), (a, v) -> {step}, a -> a.rank)")


def multiset_unrank(rank: int, counts) -> list[int]:
    left, out = list(counts), []
    n = sum(left)
    for at in range(n):
        for v, c in enumerate(left):
            if not c:
                continue
            left[v] -= 1
            ways = factorial(n - at - 1)
            for x in left:
                ways //= factorial(x)
            if rank < ways:
                out.append(v)
                break
            rank -= ways
            left[v] += 1
    return out


def position_orbits(spec: GraphSpec) -> list[tuple[list[int], list[int], list[int]]]:
    """(places, symbols, counts) of each class of places that the moves connect, by least place. The words over all
    classes are closed under the moves; not each of them need be reachable."""
    root = list(range(len(spec.start)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for g in spec.generators:
        for to, source in enumerate(g):
            root[max(top(to), top(source))] = min(top(to), top(source))
    out, size = [], 1
    for least in sorted({top(i) for i in root}):
        places = [i for i in range(len(root)) if top(i) == least]
        held = [spec.start[i] for i in places]
        symbols = sorted(set(held))
        out.append((places, symbols, [held.count(v) for v in symbols]))
        size *= words_of(out[-1][2])
    if size >= 1 << 63:
        raise GraphError("BITMAP_DOMAIN_OVERFLOW")
    return out


def words_of(counts) -> int:
    out = factorial(sum(counts))
    for c in counts:
        out //= factorial(c)
    return out


def orbit_rank(state: str, spec: GraphSpec) -> Column:
    """Mixed-radix place of a state: one digit for each class of places, the first the most significant."""
    out = F.lit(0).cast("long")
    for places, symbols, counts in position_orbits(spec):
        known = f"array({', '.join(f'{v}L' for v in symbols)})"
        word = "array(" + ", ".join(f"array_position({known}, {state}[{i}]) - 1" for i in places) + ")"
        out = out * words_of(counts) + multiset_rank(word, counts)
    return out


def orbit_unrank(rank: int, spec: GraphSpec) -> list[int]:
    domains = position_orbits(spec)
    state = [0] * len(spec.start)
    for places, symbols, counts in reversed(domains):
        rank, digit = divmod(rank, words_of(counts))
        for i, v in zip(places, multiset_unrank(digit, counts), strict=True):
            state[i] = symbols[v]
    if rank:
        raise GraphError("BITMAP_RANK_RANGE")
    return state


#: Shifts and (signed) multipliers of the SplitMix64 finaliser.
FINALISER = ((30, -4658895280553007687), (27, -7723592293110705685), (31, 1))


def _mixed(h: str) -> str:
    """SQL of the finaliser; lambda variables bind each step's value, so that it isn't written out twice."""
    steps = ", ".join(f"named_struct('s', {s}, 'f', {f}L)" for s, f in FINALISER)
    return f"aggregate(array({steps}), {h}, (a, x) -> (a ^ shiftrightunsigned(a, x.s)) * x.f)"


#: Fixed value: what the variant of the finaliser for keys adds first (2^64 over the golden ratio, signed).
GOLDEN = -7046029254386353131


def mixed_key(key: str) -> Column:
    """The finaliser after the constant is added; needs ANSI mode off."""
    return F.expr(_mixed(f"({key} + {GOLDEN}L)"))


def state_hash(state: str, n: int, seed: int = 0) -> Column:
    """h = mix(h ^ element ^ place) over the elements, mixed once more; needs ANSI mode off."""
    return F.expr(_mixed(f"aggregate(sequence(0, {n - 1}), {seed}L, (h, i) -> {_mixed(f'(h ^ {state}[i] ^ bigint(i))')})"))


#: The prime of the four-lane hash, and the widths it takes.
PRIME, HASHED_BYTES = 4294967291, range(1, 33026)


def hash_terms(width: int, seed: bytes, domain: bytes) -> tuple[list[list[int]], list[int]]:
    """(coefficients by position and lane, offsets) of the four-lane hash of ``width`` bytes.

    SHAKE-256 reads ``domain``, a zero byte, the width (u32, little-endian) and the 16 bytes of the seed. Its output is cut
    into little-endian 32-bit words; those from PRIME on are passed over; the rest are the coefficients in position-major
    order and then the four offsets.
    """
    if width not in HASHED_BYTES:
        raise GraphError("HASH_ACCUMULATOR_BOUND")
    if len(seed) != 16:
        raise GraphError("HASH_SEED")
    xof, need = hashlib.shake_256(domain + b"\0" + width.to_bytes(4, "little") + seed), 4 * (width + 1)
    extra = 64
    while True:
        raw = xof.digest(4 * (need + extra))
        words = [w for i in range(0, len(raw), 4) if (w := int.from_bytes(raw[i : i + 4], "little")) < PRIME][:need]
        if len(words) == need:
            return [words[4 * i : 4 * i + 4] for i in range(width)], words[-4:]
        extra *= 2


def modular_hash(state: str, n: int, seed: bytes = bytes(16), domain: bytes = b"GEMM_U8_P32X4/V1") -> list[Column]:
    """Four 32-bit lanes (b_j + sum of x_i * a_ij) mod PRIME of a state of n bytes (array of 0..255); see ``hash_terms``.
    Products stay below 2^40, so sums of up to 33,025 are exact."""
    a, b = hash_terms(n, seed, domain)
    return [F.expr(" + ".join([f"{b[j]}L", *[f"{state}[{i}] * {a[i][j]}L" for i in range(n)]])) % PRIME for j in range(4)]


def little_endian(word: Column, size: int) -> Column:
    """The lowest ``size`` bytes of a number, the lowest first."""
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.substring(F.lpad(F.hex(word), 16, "0"), 17 - 2 * size, 2 * size), F.lit("(..)"), F.lit(1))), ""))


def hash_bytes(lanes: list[Column]) -> Column:
    """The 16 bytes of a four-lane hash, each lane little-endian."""
    return F.concat(*[little_endian(x, 4) for x in lanes])


def state_bytes(state: str) -> Column:
    """A state of labels from 0 to 255 as bytes."""
    return F.unhex(F.array_join(F.transform(state, lambda x: F.lpad(F.hex(x), 2, "0")), ""))


def parse_seed(text: str) -> bytes:
    if len(text) != 32 or any(c not in "0123456789abcdefABCDEF" for c in text):
        raise GraphError("HASH_SEED")
    return bytes.fromhex(text)


def owner(h: Column, world: int) -> Column:
    """(high 32 bits * world) >> 32."""
    return F.shiftright(F.shiftrightunsigned(h, 32) * world, 32)


def shard(h: Column, shards: int) -> Column:
    return F.shiftright(h.bitwiseAND(0xFFFFFFFF) * shards, 32)


def owner_by_cuts(h: Column, cuts) -> Column:
    """The number of cuts (ascending 32-bit bounds of owners' ends) at or below the high word."""
    high = F.shiftrightunsigned(h, 32)
    return sum(((high >= c).cast("int") for c in cuts), F.lit(0))


def located(h: Column, world: int, shards: int, buckets: int) -> list[Column]:
    """(owner, shard, bucket) from the top bits of a 64-bit word; all counts are powers of two."""
    if any(n < 1 or n & (n - 1) for n in (world, shards, buckets)):
        raise GraphError("TOPOLOGY_POWER_OF_TWO")
    out, used = [], 0
    for n in (world, shards, buckets):
        used += n.bit_length() - 1
        out.append(F.shiftrightunsigned(h, 64 - used).bitwiseAND(n - 1) if used else F.lit(0).cast("long"))
    return out


def high_word(lanes: list[Column]) -> Column:
    """The most significant 64 bits of a four-lane hash: lane 3, then lane 2."""
    return F.shiftleft(lanes[3], 32).bitwiseOR(lanes[2])


def rank_owner(rank: Column, world: int) -> tuple[Column, Column]:
    """(owner, local rank) of a bitmap partition, and rank = local * world + owner."""
    return F.pmod(rank, F.lit(world)), F.call_function("div", rank, F.lit(world))


def _stripe_turn(stripe: str, world: int) -> str:
    """SQL: the finaliser of a stripe's number, as an unsigned value modulo ``world``."""
    m = _mixed(stripe)
    return f"pmod(pmod(shiftrightunsigned({m}, 1), {world}L) * 2 + ({m} & 1L), {world}L)"


def page_map(rank: str, total: int, world: int, page: int) -> Column:
    """A bijection of 0..total-1: in each whole stripe of ``world`` pages the pages' owners turn by a hash of the stripe,
    and what is beyond the last whole stripe stays. Page 0 turns nothing. Needs ANSI mode off."""
    edge = _turned(total, world, page)
    if not edge:
        return F.expr(rank)
    stripe, slot = f"({rank} div {page * world}L)", f"({rank} div {page}L % {world}L)"
    turned = f"({stripe} * {page}L + {rank} % {page}L) * {world}L + ({slot} + {_stripe_turn(stripe, world)}) % {world}L"
    return F.expr(f"IF({rank} >= {edge}L, {rank}, {turned})")


def page_unmap(mapped: str, total: int, world: int, page: int) -> Column:
    edge = _turned(total, world, page)
    if not edge:
        return F.expr(mapped)
    own, local = f"({mapped} % {world}L)", f"({mapped} div {world}L)"
    stripe = f"({local} div {page}L)"
    back = f"(({stripe} * {world}L + pmod({own} - {_stripe_turn(stripe, world)}, {world}L)) * {page}L + {local} % {page}L)"
    return F.expr(f"IF({mapped} >= {edge}L, {mapped}, {back})")


def _turned(total: int, world: int, page: int) -> int:
    """Ranks below it turn."""
    if total < 1 or not 1 <= world <= 128 or not 0 <= page <= 1 << 20 or page & (page - 1):
        raise GraphError("BITMAP_PAGE_MAP_RANGE")
    return total - total % (page * world) if page else 0


def _signed(v: int) -> int:
    return (v + (1 << 63)) % (1 << 64) - (1 << 63)


#: What the two words of a lossless key are combined with before they are mixed.
KEY_SALTS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def lossless_key(state: str, n: int, bits: int) -> list[Column]:
    """(low, high) words of a state of up to 128 bits, mixed by a reversible network. Needs ANSI mode off."""
    if not n or not 1 <= bits <= 8 or n * bits > 128:
        raise GraphError("LOSSLESS_KEY_DOMAIN")
    low = [f"shiftleft({state}[{i}], {bits * i})" for i in range(n) if bits * i < 64]
    high = [f"shiftleft({state}[{i}], {bits * i - 64})" if bits * i >= 64 else f"shiftrightunsigned({state}[{i}], {64 - bits * i})" for i in range(n) if bits * (i + 1) > 64]
    mix = lambda v, salt: _mixed(f"({v} ^ {_signed(salt)}L)")
    words = f"named_struct('lo', {' | '.join(low)}, 'hi', {' | '.join(high) or '0L'})"
    first = f"transform(array({words}), w -> named_struct('lo', w.lo ^ {mix('w.hi', KEY_SALTS[0])}, 'hi', w.hi))"
    both = F.expr(f"transform({first}, w -> named_struct('lo', w.lo, 'hi', w.hi ^ {mix('w.lo', KEY_SALTS[1])}))[0]")
    return [both["lo"], both["hi"]]


def lossless_words(low: str, high: str) -> list[Column]:
    """The packed words that ``lossless_key`` mixed."""
    hi = f"({high} ^ {_mixed(f'({low} ^ {_signed(KEY_SALTS[1])}L)')})"
    return [F.expr(f"{low} ^ {_mixed(f'({hi} ^ {_signed(KEY_SALTS[0])}L)')}"), F.expr(hi)]


def affine_key(key: str, seed: bytes) -> Column:
    """(key ^ a) * b modulo 2^64 of a packed state, b odd. Needs ANSI mode off."""
    v = int.from_bytes(seed, "big")
    odd, flip = (v ^ v >> 64) | 1, v ^ v << 32
    return F.expr(f"({key} ^ {_signed(flip % (1 << 64))}L) * {_signed(odd % (1 << 64))}L")


def inversions(state: str, n: int) -> Column:
    return F.expr(" + ".join(f"int({state}[{i}] > {state}[{j}])" for i in range(n) for j in range(i + 1, n)) or "0")


def parity(state: str, n: int) -> Column:
    return inversions(state, n) % 2


def cycle_count(state: str, n: int) -> Column:
    """Places that are the least of their cycle: none of the n - 1 next places along it is less."""
    def least(i: int) -> str:
        return f"int(aggregate(sequence(1, {n}), named_struct('at', {i}L, 'low', {i}L), (a, k) -> named_struct('at', {state}[int(a.at)], 'low', least(a.low, {state}[int(a.at)])), a -> a.low) = {i})"

    return F.expr(" + ".join(least(i) for i in range(n)))


def star_length(state: str, n: int) -> Column:
    """Least number of swaps with place 0: m moved places in c nontrivial cycles cost m + c, or m + c - 2 if 0 is moved."""
    moved = F.expr(" + ".join(f"int({state}[{i}] <> {i})" for i in range(n)))
    cycles = cycle_count(state, n) - (n - moved)
    return moved + cycles - F.when(F.col(state)[0] != 0, 2).otherwise(0)


def weight(code: str, digits: int, base: int) -> Column:
    """Digits that aren't zero."""
    return F.expr(" + ".join(f"int(({code} div {base**i}L) % {base} <> 0)" for i in range(digits)))


def ring_distance(a: Column, b: Column, n: int) -> Column:
    d = F.pmod(a - b, F.lit(n))
    return F.least(d, n - d)


def suffix_overlap(a: str, b: str, n: int) -> Column:
    """The longest suffix of word ``a`` that is a prefix of word ``b`` (arrays of n letters); n minus it is the distance of
    shift-append moves."""
    return F.expr("CASE " + " ".join(f"WHEN slice({a}, {n - k + 1}, {k}) = slice({b}, 1, {k}) THEN {k}" for k in range(n, 0, -1)) + " ELSE 0 END")


def in_layout(candidates: str, order: str) -> tuple[str, str]:
    """Sort keys of candidates (parent_ord, move): by parent first, or by generator first. It changes locality only."""
    if order not in ("parent_major", "generator_major"):
        raise GraphError("LAYOUT_ORDER")
    return (f"{candidates}parent_ord", f"{candidates}move") if order == "parent_major" else (f"{candidates}move", f"{candidates}parent_ord")
