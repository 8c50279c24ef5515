"""Adaptive context-mixing range coder for token ids.

Blocks are coded independently, each from a reset model, many side by side: one numpy step codes one id of every block.
Three orders predict the next id, and their predictions are mixed into one distribution:

* order 2 and order 1 say which id last followed the same two ids, or the same id, each with a strength for its run of hits;
* order 0, of strength 1, gives each class of ids (half octaves) an adaptive frequency, and the ids of a class equal shares.

An order has its strength's share of the whole, and an id has the shares of the orders that predict it, added up; coding it
is one narrowing of the range. After every few ids each block adapts its strengths, so that the predictions of a run hold as
often as the mixture expected (iterative scaling), and its classes' frequencies. The arithmetic is on integers, or on
floats with nothing but + - * / of two numbers in a fixed order, which IEEE 754 settles: a block decodes alike on any machine.
"""

from __future__ import annotations

import numpy as np

#: A lane's range is below 2**64, and 2**32 or more after each step; digits have 32 bits; a mixture's parts add up to 2**30.
KEEP = np.uint64(1 << 32)
TOTAL_BITS = 30
TOTAL = 1 << TOTAL_BITS
DIGIT = np.uint64(32)
SLOTS_LOG2 = 11
RUNS_LOG2 = 3  # a slot's run: 0 for no prediction, 1 for a new one, and one more for each hit up to the most
RUNS = 1 << RUNS_LOG2
FREQUENCY_BITS = 13
LEAST_LEFT = 5  # order 0 keeps 1 / 2**LEAST_LEFT of the whole, enough to code any id
LEAST, MOST = 2.0**-12, 2.0**LEAST_LEFT / 2 - 0.5  # of one order's strength, if it predicts
FIRST, PERIOD = 8, 64  # ids after which the model adapts: FIRST, then twice as many, up to PERIOD
TRUST = 1.0  # expected hits that count beside those of the last period
GROWTH = 24


def class_bits(vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """First id and width (as a power of two) of the classes: 0, 1, 2, 3, 4-5, 6-7, 8-11, 12-15, 16-23, ..."""
    first, bits = [0, 1], [0, 0]
    k = 1
    while 1 << k < vocabulary:
        first += [1 << k, 3 << (k - 1)]
        bits += [k - 1, k - 1]
        k += 1
    return np.array(first), np.array(bits)


class Encoder:
    def __init__(self, lanes: int, steps: int) -> None:
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, (1 << 64) - 1, np.uint64)
        self.digits = np.zeros((lanes, steps // 2 + 8), np.int64)  # the first stays free for a carry
        self.at = np.ones(lanes, np.int64)
        self.most = 1  # no lane has more digits

    def code(self, unit: np.ndarray, below: np.ndarray, width: np.ndarray) -> None:
        low = self.low + unit * below
        over = np.flatnonzero(low < self.low)
        if len(over):
            self.digits[over, self.at[over] - 1] += 1
        rng = unit * width
        short = np.flatnonzero(rng < KEEP)
        if len(short):
            at, some = self.at[short], low[short]
            self.most += 1
            if self.most + 4 > self.digits.shape[1]:
                self.most = int(self.at.max()) + 1
                if self.most + 4 > self.digits.shape[1]:
                    self.digits = np.concatenate((self.digits, np.zeros_like(self.digits)), axis=1)
            self.digits[short, at] = (some >> DIGIT).view(np.int64)
            self.at[short] = at + 1
            low[short] = some << DIGIT
            rng[short] <<= DIGIT
        self.low, self.range = low, rng

    def finish(self) -> list[bytes]:
        lane = np.arange(len(self.low))
        for k in range(2):
            self.digits[lane, self.at + k] = ((self.low >> np.uint64(32 - 32 * k)) & np.uint64(0xFFFFFFFF)).view(np.int64)
        self.at += 2
        digits = self.digits[:, : int(self.at.max())]
        while (digits > 0xFFFFFFFF).any():  # a carry goes on to the digit before
            carry = digits >> 32
            digits &= 0xFFFFFFFF
            digits[:, :-1] += carry[:, 1:]
        return [digits[k, 1 : self.at[k]].astype(">u4").tobytes() for k in range(len(lane))]


class Decoder:
    def __init__(self, payloads: list[bytes]) -> None:
        self.digits = np.zeros((len(payloads), max(len(x) for x in payloads) // 4 + 4), np.uint64)
        for k, x in enumerate(payloads):
            self.digits[k, : len(x) // 4] = np.frombuffer(x, ">u4")
        self.range = np.full(len(payloads), (1 << 64) - 1, np.uint64)
        self.value = (self.digits[:, 0] << DIGIT) | self.digits[:, 1]  # of the code, less the range's low end
        self.at = np.full(len(payloads), 2, np.int64)
        self.most = self.digits.shape[1] - 1

    def code(self, unit: np.ndarray, below: np.ndarray, width: np.ndarray) -> None:
        value, rng = self.value - unit * below, unit * width
        short = np.flatnonzero(rng < KEEP)
        if len(short):
            at = self.at[short]
            value[short] = (value[short] << DIGIT) | self.digits[short, np.minimum(at, self.most)]
            self.at[short] = at + 1
            rng[short] <<= DIGIT
        self.value, self.range = value, rng


class _Model:
    """What adapts, by lane: strengths of the orders' predictions by run, and the frequencies of classes."""

    def __init__(self, lanes: int, vocabulary: int) -> None:
        self.lanes = lanes
        self.first, self.bits = class_bits(vocabulary)
        self.n = len(self.first)
        self.of = np.repeat(np.arange(self.n), 1 << self.bits)[:vocabulary]
        # a class of many ids keeps as much as gives each of them a part, whatever is left of the mixture
        self.least = np.maximum(1, (1 << self.bits) >> (TOTAL_BITS - LEAST_LEFT - FREQUENCY_BITS - 1))
        self.counts = np.full(lanes * (self.n + 1), 2, np.int64)
        self.two = np.tile(np.concatenate(([0.0], np.linspace(0.4, 6.0, RUNS - 1))), lanes).astype(np.float32)
        self.one = np.tile(np.concatenate(([0.0], np.linspace(0.2, 2.0, RUNS - 1))), lanes).astype(np.float32)
        self.base = np.arange(lanes) << RUNS_LOG2
        self._frequencies()

    def rows(self, slots: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """Where the strengths of predictions are."""
        return np.add(slots & (RUNS - 1), self.base, out=out)

    def parts(self, run2: np.ndarray, run1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the predictions of orders 2 and 1 have of the whole."""
        a, b = self.two.take(run2), self.one.take(run1)
        share = a + b
        share += 1
        np.divide(_WHOLE, share, out=share)
        a *= share
        b *= share
        return a.astype(np.uint32), b.astype(np.uint32)

    def _frequencies(self) -> None:
        counts = self.counts.reshape(self.lanes, self.n + 1)
        sums = np.cumsum(counts[:, : self.n], axis=1)
        total = sums[:, -1:]
        ends = sums * ((1 << FREQUENCY_BITS) - int(self.least.sum())) // total + np.cumsum(self.least)
        self.ends = np.ascontiguousarray(ends.T.astype(np.int16))  # by class and lane
        low = np.concatenate((np.zeros((1, self.lanes), np.int64), ends.T))
        self.low, self.size = low[:-1].ravel(), np.diff(low, axis=0).ravel()
        much = np.flatnonzero(total[:, 0] > 6000)
        if len(much):
            counts[much] = (counts[much] >> 1) | 1

    def adapt(self, run2: np.ndarray, run1: np.ndarray, part2: np.ndarray, part1: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, kinds: np.ndarray) -> None:
        """By step and lane: the rows of the strengths, the orders' parts of the whole, whether they held, the class (or n)."""
        expected2, expected1 = part2 * (1 / TOTAL), part1 * (1 / TOTAL)
        shared = expected2 / np.maximum(expected2 + expected1, 1 / TOTAL)  # of a hit that both predicted
        for strength, run, expected, held in (
            (self.two, run2, expected2, np.where(hit1, shared, 1.0) * hit2), (self.one, run1, expected1, np.where(hit2, 1.0 - shared, 1.0) * hit1),
        ):
            n = len(strength)
            got = np.bincount(run.ravel(), held.ravel(), n)
            want = np.bincount(run.ravel(), expected.ravel(), n)
            new = np.minimum(strength * ((got + TRUST) / (want + TRUST)), MOST)
            strength[:] = np.maximum(new, (strength > 0) * LEAST)
        self.counts += GROWTH * np.bincount((kinds + np.arange(self.lanes) * (self.n + 1)).ravel(), minlength=len(self.counts))
        self._frequencies()


class _Slots:
    """What last followed a context, by lane and slot: (id + 1) << RUNS_LOG2 | run; 0: nothing yet."""

    def __init__(self, lanes: int) -> None:
        self.two, self.one = np.zeros(lanes << SLOTS_LOG2, np.int32), np.zeros(lanes << SLOTS_LOG2, np.int32)
        self.base = np.arange(lanes) << SLOTS_LOG2

    def places(self, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of orders 2 and 1; `before` is already hashed by hashed()."""
        mixed = last * _BY_LAST
        at1 = (mixed >> _SHIFT) + self.base
        mixed += before
        return (mixed >> _SHIFT) + self.base, at1

    def learn(self, at2: np.ndarray, at1: np.ndarray, s2: np.ndarray, s1: np.ndarray, code: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """A miss leaves a new prediction, a hit the same one with a longer run. code: (id + 1) << RUNS_LOG2 | 1."""
        r2, r1 = s2 & (RUNS - 1), s1 & (RUNS - 1)
        r2 *= hit2
        r1 *= hit1
        np.minimum(r2, RUNS - 2, out=r2)
        np.minimum(r1, RUNS - 2, out=r1)
        self.two[at2], self.one[at1] = np.add(r2, code, out=r2), np.add(r1, code, out=r1)


_TOTAL_BITS, _WHOLE = np.uint64(TOTAL_BITS), np.float32(TOTAL)
_SHIFT, _BY_LAST, _BY_BEFORE = np.uint32(32 - SLOTS_LOG2), np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def _encode(ids: np.ndarray, vocabulary: int) -> list[bytes]:
    """ids: steps x lanes. Of each period, first what the orders predict, then all parts at once, then the range coder."""
    steps, lanes = ids.shape
    coder, model, slots = Encoder(lanes, steps), _Model(lanes, vocabulary), _Slots(lanes)
    lane, nothing = np.arange(lanes), np.zeros((2, lanes), np.uint32)
    start, until = 0, FIRST
    while start < steps:
        now = ids[start : start + until]
        n = len(now)
        past = np.concatenate((nothing, now.astype(np.uint32)))
        nothing = past[-2:]
        at2, at1 = slots.places(past[1:-1], past[:-2] * _BY_BEFORE)
        code = now + 1 << RUNS_LOG2
        s2, s1 = np.empty((n, lanes), np.int32), np.empty((n, lanes), np.int32)
        hit2, hit1 = np.empty((n, lanes), bool), np.empty((n, lanes), bool)
        for k in range(n):
            slots.two.take(at2[k], out=s2[k], mode="clip")
            slots.one.take(at1[k], out=s1[k], mode="clip")
            np.less(code[k] ^ s2[k], RUNS, out=hit2[k])
            np.less(code[k] ^ s1[k], RUNS, out=hit1[k])
            slots.learn(at2[k], at1[k], s2[k], s1[k], code[k] + 1, hit2[k], hit1[k])
        run2, run1 = model.rows(s2), model.rows(s1)
        f2, f1 = model.parts(run2, run1)
        # the parts in order: order 2's prediction, order 1's, order 0
        width = f2 * hit2
        below = f2 - width
        width += f1 * hit1
        left = np.flatnonzero(~(hit2 | hit1))
        kinds = np.full(n * lanes, model.n, np.uint8)
        some = now.ravel()[left]
        kind = model.of[some]
        kinds[left] = kind
        base = f2.ravel()[left].astype(np.int64) + f1.ravel()[left]
        each, row, bit = TOTAL - base >> FREQUENCY_BITS, kind * lanes + lane[left % lanes], model.bits[kind]
        inner = each * model.size.take(row) >> bit
        below.ravel()[left] = base + each * model.low.take(row) + inner * (some - model.first[kind])
        width.ravel()[left] = inner
        for k in range(n):
            coder.code(coder.range >> _TOTAL_BITS, below[k], width[k])
        model.adapt(run2, run1, f2, f1, hit2, hit1, kinds.reshape(n, lanes))
        start, until = start + n, min(2 * until, PERIOD)
    return coder.finish()


def _decode(payloads: list[bytes], steps: int, vocabulary: int) -> np.ndarray:
    """steps x lanes: the same model, id by id."""
    lanes = len(payloads)
    coder, model, slots = Decoder(payloads), _Model(lanes, vocabulary), _Slots(lanes)
    run2, run1 = np.zeros((PERIOD, lanes), np.int64), np.zeros((PERIOD, lanes), np.int64)
    part2, part1 = np.zeros((PERIOD, lanes), np.uint32), np.zeros((PERIOD, lanes), np.uint32)
    held2, held1 = np.zeros((PERIOD, lanes), bool), np.zeros((PERIOD, lanes), bool)
    kinds, goals = np.zeros((PERIOD, lanes), np.uint8), np.zeros(lanes, np.int16)
    last, before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
    out = np.empty((steps, lanes), np.int32)
    k, until, most = 0, FIRST, np.uint64((1 << FREQUENCY_BITS) - 1)
    for t in range(steps):
        at2, at1 = slots.places(last, before)
        before = last * _BY_BEFORE
        s2, s1 = slots.two.take(at2), slots.one.take(at1)
        f2, f1 = model.parts(model.rows(s2, run2[k]), model.rows(s1, run1[k]))
        part2[k], part1[k] = f2, f1
        both = f2 + f1
        unit, value = coder.range >> _TOTAL_BITS, coder.value
        code = np.where(value < unit * f2, s2, s1) & -RUNS
        left = np.flatnonzero(value >= unit * both)
        kinds[k] = model.n
        if len(left):
            base, measure = both[left].astype(np.int64), unit[left]
            each = TOTAL - base >> FREQUENCY_BITS  # of order 0, for a frequency of 1
            rest = value[left] - measure * base.view(np.uint64)
            goals[left] = np.minimum(rest // (measure * each.view(np.uint64)), most)
            kind = np.add.reduce((model.ends <= goals).view(np.int8), 0, np.int8)[left].astype(np.int64)
            row, bit = kind * lanes + left, model.bits[kind]
            inner, here = each * model.size.take(row) >> bit, each * model.low.take(row)
            place = np.minimum((rest - measure * here.view(np.uint64)) // (measure * inner.view(np.uint64)), (1 << bit).view(np.uint64) - np.uint64(1)).view(np.int64)
            kinds[k, left] = kind
            code[left] = model.first[kind] + place + 1 << RUNS_LOG2
        hit2, hit1 = np.less(code ^ s2, RUNS, out=held2[k]), np.less(code ^ s1, RUNS, out=held1[k])
        width = f2 * hit2
        below = f2 - width
        width += f1 * hit1
        if len(left):
            below[left] = base + here + inner * place
            width[left] = inner
        coder.code(unit, below, width)
        now = np.subtract(code >> RUNS_LOG2, 1, out=out[t])
        code += 1
        slots.learn(at2, at1, s2, s1, code, hit2, hit1)
        last = now.astype(np.uint32)
        k += 1
        if k == until:
            model.adapt(run2[:k], run1[:k], part2[:k], part1[:k], held2[:k], held1[:k], kinds[:k])
            k, until = 0, min(2 * until, PERIOD)
    return out


def encode_blocks(blocks: list[np.ndarray], steps: int, vocabulary: int) -> list[bytes]:
    """A payload for each block of `steps` ids at most; shorter ones are filled up with zeros."""
    steps = min(steps, max(map(len, blocks), default=0))
    ids = np.zeros((steps, len(blocks)), np.int32)
    for k, x in enumerate(blocks):
        ids[: len(x), k] = x
    if ids.size and not 0 <= ids.min() <= ids.max() < vocabulary:
        raise ValueError("an id is outside the vocabulary")
    return _encode(ids, vocabulary)


def decode_blocks(payloads: list[bytes], counts: list[int], vocabulary: int) -> list[np.ndarray]:
    """The ids of each block again."""
    out = _decode(payloads, max(counts), vocabulary)
    return [out[:n, k].astype(np.uint32) for k, n in enumerate(counts)]
