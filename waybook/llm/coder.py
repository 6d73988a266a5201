"""An adaptive context-mixing range coder for token ids.

Each block starts from nothing. Three predictions are mixed for every id: the id
that last followed the two ids before (order 2), the one that last followed the id
before (order 1), and the frequencies of the ids seen in the block so far (order 0).
Weights of orders 2 and 1 are learnt per state of confidence; what they leave is
order 0's, which is brought up to date at fixed steps. The mixture is one interval of
the range coder. An id that order 0 does not know yet is written as it is.

Many blocks are coded side by side, one numpy lane each: step by step, every lane codes
one id. Lanes share no state, so a block's bytes do not depend on the others.
"""

from __future__ import annotations

import numpy as np

#: Ids per block.
BLOCK = 8192
#: Blocks coded side by side; a lane takes about 0.25 MB for a vocabulary of 50 000.
LANES = 512
#: Steps at which order 0 is brought up to date.
STEPS = frozenset([32, 64, 128, 256, 512, 1024, 1536, 2048, 3072, 4096, 5120, 6144, 7168])
#: Bits of order 0's frequencies, of the mixture, and of pairs that share a place in order 2.
ORDER0, MIX, PAIRS = 14, 12, 13
#: Learnt weights are 16-bit numbers between these two; each outcome moves them by a 32nd.
LOW, HIGH, RATE = 1024, 64000, 5

_TOTAL = ORDER0 + MIX
_TOP, _WINDOW = 1 << 32, (1 << 48) - 1


class _Model:
    """Predictions of all lanes, the same in encoder and decoder."""

    def __init__(self, lanes: int, vocabulary: int, steps: int, inverse: bool):
        self.width = steps + 1  # slot 0 stands for ids without a place yet
        self.vocabulary = vocabulary
        self.slot_of = np.zeros(lanes * vocabulary, np.int16)
        self.id_of = np.zeros(lanes * self.width, np.int32)
        self.seen = np.zeros(lanes, np.int64)
        self.known = np.zeros(lanes, np.int64)
        self.count = np.zeros((lanes, self.width), np.int32)
        self.cum = np.zeros((lanes, self.width + 1), np.int32)
        self.cum[:, 1:] = 1 << ORDER0
        self.slots = np.zeros((lanes, 1 << ORDER0), np.int16) if inverse else None
        self.one = np.zeros(lanes * self.width, np.int32)
        self.two = np.zeros(lanes << PAIRS, np.int32)
        state = np.arange(32)
        sure2, sure1, agree = state >> 3, (state >> 1) & 3, state & 1
        self.use2, self.use1 = (sure2 > 0).astype(np.int64), ((sure1 > 0) & (agree == 0)).astype(np.int64)
        self.weight2 = np.tile(np.where(self.use2, 8192 * np.maximum(sure2, 1), 0), lanes)
        self.weight1 = np.tile(np.where(self.use1, 8192 * np.maximum(sure1, 1), 0), lanes)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        lane = np.arange(lanes)
        self.at_id, self.at_slot, self.at_cum, self.at_two, self.at_state = lane * vocabulary, lane * self.width, lane * (self.width + 1), lane << PAIRS, lane << 5
        self.at_inverse = lane << ORDER0

    def predict(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Guesses of orders 2 and 1 and their parts of 2 ** MIX, for the first k lanes."""
        self.i2 = self.at_two[:k] + ((self.last[:k] * 40503 + self.before[:k] * 30011) & ((1 << PAIRS) - 1))
        self.i1 = self.at_slot[:k] + self.last[:k]
        self.v2, self.v1 = self.two[self.i2], self.one[self.i1]
        self.c2, self.c1 = self.v2 >> 16, self.v1 >> 16
        g2, g1 = self.v2 & 0xFFFF, self.v1 & 0xFFFF
        self.state = (self.c2 << 3) + (self.c1 << 1) + (g1 == g2)
        self.iw = self.at_state[:k] + self.state
        self.w2, self.w1 = self.weight2[self.iw], self.weight1[self.iw]
        p2 = self.w2 >> (16 - MIX)
        return g2, g1, p2, (((1 << MIX) - p2) * self.w1) >> 16

    def learn(self, k: int, ids: np.ndarray, slot: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, g2: np.ndarray, g1: np.ndarray) -> None:
        new = np.flatnonzero(slot == 0)
        if len(new):
            self.seen[new] += 1
            slot[new] = self.seen[new]
            self.slot_of[self.at_id[new] + ids[new]] = slot[new]
            self.id_of[self.at_slot[new] + slot[new]] = ids[new]
        self.weight2[self.iw] = self.w2 + ((hit2 * (HIGH - LOW) + LOW - self.w2) >> RATE) * self.use2[self.state]
        self.weight1[self.iw] = self.w1 + ((hit1 * (HIGH - LOW) + LOW - self.w1) >> RATE) * (self.use1[self.state] & ~hit2)
        fresh = slot + 65536
        self.two[self.i2] = np.where(slot == g2, g2 + (np.minimum(self.c2 + 1, 3) << 16), np.where(self.c2 > 1, self.v2 - 65536, fresh))
        self.one[self.i1] = np.where(slot == g1, g1 + (np.minimum(self.c1 + 1, 3) << 16), np.where(self.c1 > 1, self.v1 - 65536, fresh))
        self.count.reshape(-1)[self.at_slot[:k] + slot] += 1
        self.before[:k] = self.last[:k]
        self.last[:k] = slot

    def refresh(self, k: int) -> None:
        """Order 0 from the counts so far; a lane's frequencies add up to 2 ** ORDER0, and slot 0 gets what rounding leaves."""
        n = int(self.seen[:k].max()) + 1
        count = self.count[:k, :n]
        held = np.arange(n) <= self.seen[:k, None]
        room = (1 << ORDER0) - 1 - self.seen[:k]
        freq = (count * room[:, None].astype(np.int32)) // count.sum(axis=1, dtype=np.int32)[:, None] + held
        freq[:, 0] += (1 << ORDER0) - freq.sum(axis=1, dtype=np.int32)
        np.cumsum(freq, axis=1, out=self.cum[:k, 1 : n + 1])
        self.cum[:k, n + 1 :] = 1 << ORDER0
        self.known[:k] = self.seen[:k]
        if self.slots is not None:
            self.slots[:k] = np.repeat(np.tile(np.arange(n, dtype=np.int16), k), freq.ravel()).reshape(k, -1)

    def interval(self, k: int, slot: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, p2: np.ndarray, p1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width in 2 ** _TOTAL."""
        at = self.at_cum[:k] + slot
        flat = self.cum.reshape(-1)
        start, end = flat[at].astype(np.int64), flat[at + 1]
        both = p2 + p1
        rest = (1 << MIX) - both
        low = np.where(hit2, 0, np.where(hit1, p2 << ORDER0, (both << ORDER0) + rest * start))
        return low, np.where(hit2, p2 << ORDER0, np.where(hit1, p1 << ORDER0, rest * (end - start)))


def lanes(vocabulary: int) -> int:
    """Side by side in about 150 MB."""
    return max(16, min(LANES, (150 << 20) // (2 * vocabulary + 24 * BLOCK + 4 * (1 << PAIRS) + 2 * (1 << ORDER0))))


def encode(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """The bytes of each block of at most BLOCK ids below `vocabulary`, 2 ** 32 at most."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    out: list[bytes] = [b""] * len(blocks)
    most = lanes(vocabulary)
    for at in range(0, len(order), most):
        group = order[at : at + most]
        for i, data in zip(group, _encode([blocks[i] for i in group], vocabulary), strict=True):
            out[i] = data
    return out


def decode(payloads: list[bytes], counts: list[int], vocabulary: int) -> list[np.ndarray]:
    order = sorted(range(len(counts)), key=lambda i: -counts[i])
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(counts)
    most = lanes(vocabulary)
    for at in range(0, len(order), most):
        group = order[at : at + most]
        for i, ids in zip(group, _decode([payloads[i] for i in group], [counts[i] for i in group], vocabulary), strict=True):
            out[i] = ids
    return out


def _encode(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    size = np.array([len(b) for b in blocks])
    lanes, steps = len(blocks), int(size.max(initial=0))
    ids = np.zeros((steps, lanes), np.int64)
    for i, b in enumerate(blocks):
        ids[: len(b), i] = b
    model, high = _Model(lanes, vocabulary, steps, False), ((vocabulary - 1) >> 16).bit_length()
    low, span, place = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64), np.zeros(lanes, np.int64)
    words = np.zeros((lanes, steps + 64), np.uint16)

    def grow() -> None:
        nonlocal words
        if place.max() + 16 > words.shape[1]:
            words = np.pad(words, ((0, 0), (0, words.shape[1])))

    def settle(lane: np.ndarray) -> None:
        """Carries into what is written, then writes until each lane's span is large again."""
        over = lane[low[lane] > _WINDOW]
        low[over] &= _WINDOW
        back = place[over] - 1
        while len(over):
            words[over, back] += 1
            more = words[over, back] == 0
            over, back = over[more], back[more] - 1
        small = lane[span[lane] <= _TOP]
        while len(small):
            words[small, place[small]] = low[small] >> 32
            place[small] += 1
            low[small] = (low[small] & (_TOP - 1)) << 16
            span[small] <<= 16
            small = small[span[small] <= _TOP]

    every = np.arange(lanes)
    active = np.searchsorted(-size, -np.arange(steps), "left")
    for t in range(steps):
        k = int(active[t])
        if t in STEPS:
            model.refresh(k)
        if not t & 1023:
            grow()
        x = ids[t, :k]
        slot = model.slot_of[model.at_id[:k] + x].astype(np.int64)
        g2, g1, p2, p1 = model.predict(k)
        found = slot > 0
        hit2 = found & (slot == g2)
        hit1 = found & (slot == g1) & ~hit2
        listed = np.where(slot <= model.known[:k], slot, 0)
        start, width = model.interval(k, listed, hit2, hit1, p2, p1)
        unit = span[:k] >> _TOTAL
        low[:k] += unit * start
        span[:k] = unit * width
        settle(every[:k])
        raw = np.flatnonzero((listed == 0) & ~hit2 & ~hit1)
        if len(raw):
            for part, bits in ((x[raw] >> 16, high), (x[raw] & 0xFFFF, 16)) if high else ((x[raw], 16),):
                unit = span[raw] >> bits
                low[raw] += unit * part
                span[raw] = unit
                grow()
                settle(raw)
        model.learn(k, x, slot, hit2, hit1, g2, g1)
    out = []
    for i in range(lanes):
        end = [low[i] >> 32, (low[i] >> 16) & 0xFFFF, low[i] & 0xFFFF]
        out.append(np.concatenate((words[i, : place[i]], np.array(end, np.uint16))).astype("<u2").tobytes().rstrip(b"\0") if size[i] else b"")
    return out


def _decode(payloads: list[bytes], counts: list[int], vocabulary: int) -> list[np.ndarray]:
    size = np.array(counts)
    lanes, steps = len(counts), int(size.max(initial=0))
    words = np.zeros((lanes, max((len(p) for p in payloads), default=0) // 2 + 8), np.uint16)
    for i, p in enumerate(payloads):
        got = np.frombuffer(p + b"\0" * (len(p) & 1), "<u2")
        words[i, : len(got)] = got
    flat, width_w = words.reshape(-1), words.shape[1]
    end = np.arange(lanes) * width_w + width_w - 1  # zeros follow a block's bytes
    ids = np.zeros((steps, lanes), np.int64)
    model, high = _Model(lanes, vocabulary, steps, True), ((vocabulary - 1) >> 16).bit_length()
    first = words[:, :3].astype(np.int64)
    code = (first[:, 0] << 32) | (first[:, 1] << 16) | first[:, 2]
    span, place = np.full(lanes, 1 << 48, np.int64), np.arange(lanes) * width_w + 3

    def settle(lane: np.ndarray) -> None:
        small = lane[span[lane] <= _TOP]
        while len(small):
            code[small] = (code[small] << 16) | flat[np.minimum(place[small], end[small])]
            place[small] += 1
            span[small] <<= 16
            small = small[span[small] <= _TOP]

    every = np.arange(lanes)
    active = np.searchsorted(-size, -np.arange(steps), "left")
    inverse = model.slots.reshape(-1)
    for t in range(steps):
        k = int(active[t])
        if t in STEPS:
            model.refresh(k)
        g2, g1, p2, p1 = model.predict(k)
        unit = span[:k] >> _TOTAL
        target = np.minimum(code[:k] // unit, (1 << _TOTAL) - 1)
        part = target >> ORDER0
        both = p2 + p1
        hit2 = part < p2
        hit1 = (part < both) & ~hit2
        deep = np.maximum(target - (both << ORDER0), 0) // ((1 << MIX) - both)
        listed = inverse[model.at_inverse[:k] + deep].astype(np.int64)
        slot = np.where(hit2, g2, np.where(hit1, g1, listed)).astype(np.int64)
        start, width = model.interval(k, listed, hit2, hit1, p2, p1)
        code[:k] -= unit * start
        span[:k] = unit * width
        settle(every[:k])
        x = model.id_of[model.at_slot[:k] + slot].astype(np.int64)
        raw = np.flatnonzero(slot == 0)
        if len(raw):
            value = np.zeros(len(raw), np.int64)
            for bits in (high, 16) if high else (16,):
                unit = span[raw] >> bits
                digit = np.minimum(code[raw] // unit, (1 << bits) - 1)
                code[raw] -= unit * digit
                span[raw] = unit
                settle(raw)
                value = (value << 16) | digit
            x[raw] = value
            slot[raw] = model.slot_of[model.at_id[raw] + value]
        ids[t, :k] = x
        model.learn(k, x, slot, hit2, hit1, g2, g1)
    return [ids[:n, i].copy() for i, n in enumerate(counts)]
