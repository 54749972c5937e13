"""Adaptive context-mixing range coder for token ids, in independent checksummed blocks.

A block holds whole documents. Its ids are cut into up to 16,384 equal lanes that are coded in step, so that each
NumPy operation codes one id of every lane; all lanes share one model, which starts empty in each block and predicts
an id by three orders:

* order 0: frequencies of all ids so far;
* order 1: frequencies of the ids that followed the id before;
* order 2: a hashed table of the id that followed the two ids before last, and how reliable it has been.

Orders 0 and 1 are mixed into one distribution for each id before: a share e of order 0, which is learned for contexts
of like counts, and 1 - e of order 1. The order-2 id gets a share of its own, learned for each pair of its reliability
and the context's count, and the mixed distribution the rest. So an id costs one step over the order-2 id and those
that order 1 has seen, and one more where neither has it: then order 0 codes it among the ids that order 1 hasn't
seen. Frequencies are renewed after 1, 2, 4, .. steps while enough steps are left to use them, shares after every fourth, from
what that step coded. Integer arithmetic only, so coder and decoder agree on every machine. Each lane is a
carry-propagating range coder: 56-bit low, 16-bit words. A step takes up to 32 bits of a size of at least 40. What
misses is looked up in the order of its keys, which is faster than in that of the lanes.

Frame: b"LWRC", version, reserved (u16 each); documents, ids, lanes (u32 each); first offset (u64); CRC-32 of all
that follows (u32). Then document ids (i64), null flags (u8), lengths (u32), words of each lane (u32), lane words (u16).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

HEAD = struct.Struct("<4sHHIIIQI")
MAGIC, VERSION = b"LWRC", 3
LANES, STEPS_LEAST = 16384, 128
SHARE_BITS, ONE_BITS, ZERO_BITS, HASH_BITS, IDS = 12, 20, 22, 20, 65536
SIZE, TOP, LOW40 = 1 << 55, np.uint64(1 << 40), np.uint64((1 << 40) - 1)
S8, S16, S24, S40, SONE, SBOTH = np.uint64(8), np.uint64(16), np.uint64(24), np.uint64(40), np.uint64(ONE_BITS), np.uint64(SHARE_BITS + ONE_BITS)
WHOLE = np.uint64(1 << SHARE_BITS)
#: reliabilities, times 32, after a miss and after a hit; an entry at 0 takes the new id at a miss
AFTER = np.array([[k // 3 * 32 for k in range(8)], [min(k + 1, 7) * 32 for k in range(8)]], np.uint8)
SPAN = 23  # bits between the order-0 places of two contexts
WORDS = 4  # that a lane may put out in a step, at most


class _Model:
    """The shared state of a block's lanes; ``see`` updates it with what every lane has just coded. Only a decoder
    looks places up (``places``)."""

    def __init__(self, steps: int, places: bool) -> None:
        self.steps, self.places = steps, places
        self.two = np.zeros(1 << HASH_BITS, np.uint32)  # order-2 ids times 256, and their reliabilities
        self.outcomes = np.tile(np.array([1, 4], np.int64), (8 * 32, 1))  # hits and all, by reliability and count
        self.novel = np.tile(np.array([1, 2], np.int64), (32 * 32, 1))  # unseen and all, by log counts of a context
        self.zero = np.zeros(IDS, np.int64)
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.step, self.due, self.fresh = 0, 1, []
        self._renew()
        self._shares()

    def _shares(self) -> None:
        self.share = (1 + self.outcomes[:, 0] * ((1 << SHARE_BITS) - 2) // self.outcomes[:, 1]).astype(np.uint64)

    def _renew(self) -> None:
        """All frequencies, from the pairs of ids since the last time. The mixed frequencies of a context, that of what
        order 1 hasn't seen included, have the sum 2**ONE_BITS."""
        if self.fresh:
            pairs, n = np.unique(np.concatenate(self.fresh), return_counts=True)
            self.fresh = []
            at = np.searchsorted(self.keys, pairs)
            known = np.zeros(len(pairs), bool)
            inside = at < len(self.keys)
            known[inside] = self.keys[at[inside]] == pairs[inside]
            of = self.bucket[pairs >> 16]
            self.novel[:, 1] += np.bincount(of, n, len(self.novel)).astype(np.int64)
            self.novel[:, 0] += np.bincount(of[~known], n[~known], len(self.novel)).astype(np.int64)
            self.zero += np.bincount(pairs & 0xFFFF, n, IDS).astype(np.int64)
            self.counts[at[known]] += n[known]
            self.keys = np.insert(self.keys, at[~known], pairs[~known])
            self.counts = np.insert(self.counts, at[~known], n[~known])
        self.f1 = self.first1 = self.place1 = self.place0 = self.guarded = None  # these go before their like is made
        f0 = 1 + self.zero * ((1 << ZERO_BITS) - IDS) // max(1, int(self.zero.sum()))
        c0 = np.cumsum(f0) - f0
        context, ids = (self.keys >> 16).astype(np.int64), (self.keys & 0xFFFF).astype(np.int64)
        distinct = np.bincount(context, minlength=IDS)
        total = np.bincount(context, self.counts, IDS).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(distinct)])
        log = np.frexp(total.astype(float))[1]
        self.log = log.astype(np.uint8)
        self.bucket = log * 32 + np.frexp(distinct.astype(float))[1]
        e = (1 + self.novel[:, 0] * ((1 << SHARE_BITS) - 2) // self.novel[:, 1])[self.bucket]
        # of each context's sum one goes to each id it has seen and one to all others; the rest is shared out
        room = ((1 << ONE_BITS) - distinct - 1)[context]
        own = e[context]
        of0 = f0[ids]
        f1 = 1 + (((1 << SHARE_BITS) - own) * self.counts * room // total[context] + (own * of0 * room >> ZERO_BITS) >> SHARE_BITS)
        del own, room
        sums = np.concatenate([[0], np.cumsum(f1)])
        first = sums[:-1] - sums[start[context]]
        sum0 = np.concatenate([[0], np.cumsum(of0)])
        del of0
        seen = sums[start[1:]] - sums[start[:-1]]
        self.start, self.sum0 = start, sum0
        self.f0, self.c0 = f0.astype(np.uint64), c0
        self.f1, self.first1 = np.append(f1, 0).astype(np.uint32), np.append(first, 0).astype(np.uint32)  # at most 2**ONE_BITS
        self.seen1, self.rest1 = seen.astype(np.uint64), ((1 << ONE_BITS) - seen).astype(np.uint64)
        self.left0 = (int(f0.sum()) - (sum0[start[1:]] - sum0[start[:-1]])).astype(np.uint64)
        if self.places:
            self.place1 = (context << ONE_BITS) + first
            self.place0 = (context << SPAN) + c0[ids] - (sum0[:-1] - sum0[start[context]])
        # a key beyond the last differs from it; without keys, the id before is 0
        self.guarded = np.append(self.keys, self.keys[-1] if len(self.keys) else np.uint32(0xFFFFFFFF))

    def predict(self, p2: np.ndarray, p1: np.ndarray) -> np.ndarray:
        """The order-2 id's share of 2**SHARE_BITS."""
        self.p1 = p1
        self.i2 = (((p2 * np.uint32(2654435761)) ^ (p1 * np.uint32(2246822519))) >> np.uint32(32 - HASH_BITS)).astype(np.intp)
        self.both = self.two.take(self.i2)
        self.a, self.k = (self.both >> np.uint32(8)).astype(np.uint16), self.both.astype(np.uint8)
        self.ctx = self.k + self.log.take(p1)
        return self.share.take(self.ctx)

    def see(self, x: np.ndarray, hit: np.ndarray) -> None:
        # a hit's id is x itself, so x goes in wherever the reliability is 0
        then = np.where(self.k == 0, x, self.a).astype(np.uint32) << np.uint32(8)
        then |= AFTER.ravel().take((self.k >> np.uint8(5)) + (hit.view(np.uint8) << np.uint8(3)))
        moved = np.flatnonzero(then != self.both)
        self.two[self.i2.take(moved)] = then.take(moved)
        self.fresh.append(self.p1 << np.uint32(16) | x)
        self.step += 1
        if self.step & 3 == 1:
            self.outcomes[:, 1] += np.bincount(self.ctx, minlength=len(self.outcomes))
            self.outcomes[:, 0] += np.bincount(self.ctx[hit], minlength=len(self.outcomes))
            self._shares()
        if self.step == self.due:
            if self.steps - self.step > self.step >> 3:
                self._renew()
            self.due = 2 * self.step


def _lanes(n: int) -> np.ndarray:
    """Ids in each lane: the first lanes have one more."""
    lanes = max(1, min(LANES, n // STEPS_LEAST))
    return np.full(lanes, n // lanes) + (np.arange(lanes) < n % lanes)


def _code(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of each lane, all words) of a block's ids."""
    per = _lanes(len(ids))
    lanes, steps = len(per), int(per[0])
    grid = np.zeros((steps, lanes), np.uint16)
    grid.T[np.arange(steps) < per[:, None]] = ids
    wide = steps + 16 * WORDS + 8  # grows if a lane needs more
    out = np.zeros((lanes, wide), np.int32)
    at = np.zeros(lanes, np.int64)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, SIZE, np.uint64)
    p2, p1 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
    model = _Model(steps, places=False)

    def shed(who: np.ndarray) -> None:
        while who.size:
            mine = low.take(who)
            out[who, at.take(who)] = mine >> S40
            at[who] += 1
            low[who] = (mine & LOW40) << S16
            size[who] = now = size.take(who) << S16
            who = who[now < TOP]

    for t in range(steps):
        if t & 15 == 0 and int(at.max()) + 16 * WORDS + 8 > out.shape[1]:
            out = np.concatenate([out, np.zeros((lanes, wide), np.int32)], 1)
        x, n = grid[t], lanes
        if t == steps - 1 and per[-1] < steps:
            n = int((per == steps).sum())
            x, p2, p1 = x[:n], p2[:n], p1[:n]
        share = model.predict(p2, p1)
        hit = x == model.a
        base, part, fresh = np.zeros(n, np.uint64), share << SONE, np.zeros(0, np.intp)
        who = np.flatnonzero(~hit)
        if who.size:
            key = p1.take(who) << np.uint32(16) | x.take(who)
            order = key.argsort()
            who, key = who.take(order), key.take(order)
            j = np.searchsorted(model.keys, key)
            first, f = model.first1.take(j), model.f1.take(j)
            fresh = np.flatnonzero(model.guarded.take(j) != key)
            if fresh.size:
                c = key.take(fresh) >> np.uint32(16)
                first[fresh], f[fresh] = model.seen1.take(c), model.rest1.take(c)
            rest = WHOLE - share.take(who)
            base[who], part[who] = part.take(who) + rest * first, rest * f
        r = size[:n] >> SBOTH
        low[:n] += r * base
        size[:n] = now = r * part
        shed(np.flatnonzero(now < TOP))
        if fresh.size:
            y, who = (key.take(fresh) & np.uint32(0xFFFF)).astype(np.intp), who.take(fresh)
            r = size.take(who) // model.left0.take(c)
            low[who] += r * (model.c0.take(y) - (model.sum0.take(j.take(fresh)) - model.sum0.take(model.start.take(c)))).astype(np.uint64)
            size[who] = now = r * model.f0.take(y)
            shed(who[now < TOP])
        model.see(x, hit)
        p2, p1 = p1, x.astype(np.uint32)
    last = (low + np.uint64(0xFFFFFF)) >> S24  # any value of the final interval; size is 2**40 or more here
    every = np.arange(lanes)
    out[every, at], out[every, at + 1] = last >> S16, last & np.uint64(0xFFFF)
    words = at + 2
    for p in range(int(words.max()) - 1, 0, -1):
        out[:, p - 1] += out[:, p] >> 16
    return words, (out & 0xFFFF)[np.arange(out.shape[1]) < words[:, None]].astype("<u2")


def _decode(n_ids: int, words: np.ndarray, flat: np.ndarray) -> np.ndarray:
    per = _lanes(n_ids)
    lanes, steps = len(per), int(per[0])
    wide = int(words.max()) + 6
    code_words = np.zeros((lanes, wide), np.uint64)
    code_words[np.arange(wide) < words[:, None]] = flat
    code_words = code_words.ravel()
    at = np.arange(lanes) * wide
    # code and size are those of the coder times 256, so that code is four words
    code = (code_words[at] << (S24 + S24)) | (code_words[at + 1] << (S16 + S16)) | (code_words[at + 2] << S16) | code_words[at + 3]
    at += 4
    size, top = np.full(lanes, SIZE << 8, np.uint64), TOP << S8
    p2, p1 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
    grid = np.zeros((steps, lanes), np.uint16)
    model = _Model(steps, places=True)

    def fill(who: np.ndarray) -> None:
        while who.size:
            place = at.take(who)
            code[who] = (code.take(who) << S16) | code_words.take(place)
            at[who] = place + 1
            size[who] = now = size.take(who) << S16
            who = who[now < top]

    for t in range(steps):
        n = lanes
        if t == steps - 1 and per[-1] < steps:
            n = int((per == steps).sum())
            p2, p1 = p2[:n], p1[:n]
        share = model.predict(p2, p1)
        part = share << SONE
        r = (size[:n] >> (SBOTH + S8)) << S8
        v = code[:n] // r
        hit = v < part
        x, base, fresh = model.a.copy(), np.zeros(n, np.uint64), np.zeros(0, np.intp)
        who = np.flatnonzero(~hit)
        if who.size:
            edge, rest = part.take(who), WHOLE - share.take(who)
            place = (p1.take(who).astype(np.uint64) << SONE) + (v.take(who) - edge) // rest
            order = place.view(np.int64).argsort()
            who, place, edge, rest = who.take(order), place.view(np.int64).take(order), edge.take(order), rest.take(order)
            c = place >> ONE_BITS
            j = np.searchsorted(model.place1, place, "right") - 1
            seen = model.seen1.take(c)
            first, f = model.first1.take(j), model.f1.take(j)
            fresh = np.flatnonzero((place & (1 << ONE_BITS) - 1).view(np.uint64) >= seen)
            if fresh.size:
                d = c.take(fresh)
                first[fresh], f[fresh] = seen.take(fresh), model.rest1.take(d)
            x[who] = model.guarded.take(j) & np.uint32(0xFFFF)
            base[who], part[who] = edge + rest * first, rest * f
        code[:n] -= r * base
        size[:n] = now = r * part
        fill(np.flatnonzero(now < top))
        if fresh.size:
            who = who.take(fresh)
            r = ((size.take(who) >> S8) // model.left0.take(d)) << S8
            v = (code.take(who) // r).astype(np.int64)
            j = np.searchsorted(model.place0, (d << SPAN) + v, "right")
            before = model.sum0.take(j) - model.sum0.take(model.start.take(d))
            y = np.searchsorted(model.c0, v + before, "right") - 1
            x[who] = y
            code[who] -= r * (model.c0.take(y) - before).astype(np.uint64)
            size[who] = now = r * model.f0.take(y)
            fill(who[now < top])
        model.see(x, hit)
        grid[t, :n] = x
        p2, p1 = p1, x.astype(np.uint32)
    return np.ascontiguousarray(grid.T)[np.arange(steps) < per[:, None]]


def write_block(doc_ids: list, lengths: list[int], ids: np.ndarray, first: int) -> bytes:
    """One frame of whole documents. ``ids``: all their ids, each below 65,536; ``first``: ids before it in its part."""
    if len(ids) and int(ids.max()) >= IDS:
        raise ValueError("TOKEN_ID_RANGE: ids must be below 65536")
    words, flat = _code(ids.astype(np.uint16, copy=False)) if len(ids) else (np.zeros(1, np.int64), np.zeros(0, "<u2"))
    body = b"".join((
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.array(lengths, "<u4").tobytes(), words.astype("<u4").tobytes(), flat.tobytes(),
    ))
    return HEAD.pack(MAGIC, VERSION, 0, len(doc_ids), len(ids), len(words), first, zlib.crc32(body)) + body


def read_block(frame: bytes) -> tuple[int, list, np.ndarray, np.ndarray]:
    """(first offset, document ids, lengths, ids) of a frame; ValueError if it isn't whole."""
    if len(frame) < HEAD.size:
        raise ValueError("BLOCK_TRUNCATED")
    magic, version, _, docs, n, lanes, first, crc = HEAD.unpack_from(frame)
    if magic != MAGIC or version != VERSION:
        raise ValueError("BLOCK_MAGIC")
    if zlib.crc32(memoryview(frame)[HEAD.size :]) != crc:
        raise ValueError("BLOCK_CHECKSUM")
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(frame, kind, count, at)
        at += got.nbytes
        return got

    doc_ids, null, lengths, words = take("<i8", docs), take("u1", docs), take("<u4", docs), take("<u4", lanes)
    flat = take("<u2", int(words.sum()))
    ids = _decode(n, words.astype(np.int64), flat) if n else np.zeros(0, np.uint16)
    return first, [None if z else int(d) for d, z in zip(doc_ids, null, strict=True)], lengths, ids
