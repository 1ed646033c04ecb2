"""Adaptive context-mixing range coder for blocks of token ids below 65,535.

Every block starts from the same state and is coded on its own. A payload has
the ids that occur in the block, in the order of their first use, and then one
range-coded interval for each of its ids: the place in that list predicted by
the last two places (order 2), that predicted by the last place (order 1), the
next new place, or a place by its bucket (order 0; frequent ids are met early,
so their places are low). The chances of these kinds are a mix: the counts seen
in the context of the order-2 prediction's confidence plus those in the context
of the order-1 prediction's confidence. Counts enter the chances at fixed
steps, more often at a block's start.

Blocks are lanes: numpy codes the next id of many blocks at once. All numbers
are whole and stay below 2 ** 53, where floats are exact.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 4096
#: Blocks that are coded side by side; about 45 KB each while they are coded.
LANES = 2048

_SLOTS = 4096
_EMPTY = (BLOCK - 1) << 2
#: Kinds of place: predicted by order 2, by order 1, new, or in a bucket: 0 to 1, 2 to 3, 4 to 7, ... 2048 to 4095.
_BY2, _BY1, _NEW, _KINDS = 0, 1, 2, 15
_KIND = np.array([2 + max(1, p.bit_length()) for p in range(BLOCK)], np.uint8)  # bucket of each place
_FIRST = np.array([0, 0, 0, 0] + [1 << b for b in range(1, 12)])  # place of each kind
_WIDTH = np.array([0, 0, 0, 1, *range(1, 12)])  # bits of the place in its bucket

#: Each of the two contexts gives half of the chances.
_HALF = 1 << 11
_REST = 11
_TOTAL = float(2 * _HALF << _REST)
_UNIT = np.ldexp(1.0, _REST - _WIDTH)
#: Least chance of each kind in a half. No place takes more than 16 bits then, so a step settles one word at most.
_LEAST = np.maximum(1, (1 << _WIDTH) >> 5)
_FREE = _HALF - int(_LEAST.sum())
_LEAST = np.cumsum(_LEAST).astype(np.uint16)
_LOW, _WORD = float(1 << 32), float(1 << 16)
#: Counts enter the chances before these steps.
_STEPS = [16, 64, 128, 256, 512, 1024, 1536, 2048, 3072]


def _prior() -> np.ndarray:
    """Counts that every block starts from: 8 contexts of order 2 and 8 of order 1, twice the confidence plus whether both agree."""
    prior = np.ones((16, _KINDS), np.float32)
    prior[:, _NEW] = 3
    for confidence, sure in enumerate((0.5, 2, 12, 40)):
        at = 2 * confidence
        prior[at:at + 2, _BY2] = prior[at + 9, _BY2] = prior[at + 8, _BY1] = sure
    prior[1::2, _BY1] = 0.1
    return prior


class _Chances:
    """The counts of some lanes, and cumulative chances (lane, pair of contexts; 16) made of them.

    A pair of contexts is 8 times the confidence of order 2, plus twice that of order 1, plus whether both agree.
    """

    def __init__(self, lanes: int):
        self.counts = np.tile(_prior(), (lanes, 1, 1))
        self.sums = np.zeros((lanes * 32, 16), np.uint16)
        self.base = np.arange(lanes, dtype=np.int32) << 9
        self._mix()

    def _mix(self) -> None:
        sums = np.cumsum(self.counts, axis=2)
        sums *= np.float32(_FREE) / sums[:, :, -1:]
        halves = np.zeros((len(sums), 2, 4, 2, 16), np.uint16)
        halves.reshape(-1, 16, 16)[:, :, 1:] = sums
        halves[..., 1:] = np.minimum(halves[..., 1:], np.uint16(_FREE)) + _LEAST
        halves[..., _KINDS] = _HALF
        np.add(halves[:, 0, :, None], halves[:, 1, None], out=self.sums.reshape(-1, 4, 4, 2, 16))

    def count(self, pairs: np.ndarray, kinds: np.ndarray) -> None:
        """(step, lane) arrays of pairs of contexts and kinds: of the first lanes, those that go on."""
        for at in range(0, kinds.shape[1], 64):
            some = np.s_[:, at:at + 64]
            key = (pairs[some].astype(np.int64) << 4) + kinds[some]
            lanes = key.shape[1]
            key += self.base[:lanes]
            got = np.bincount(key.ravel(), minlength=lanes << 9).reshape(-1, 4, 4, 2, 16)[..., :_KINDS]
            self.counts[at:at + lanes, :8] += got.sum(2).reshape(-1, 8, _KINDS)
            self.counts[at:at + lanes, 8:] += got.sum(1).reshape(-1, 8, _KINDS)
        self._mix()


def _slot2(last2, last1):
    return ((last2 << 6) + last1) & (_SLOTS - 1)


def _spans(sizes: np.ndarray):
    """(first step, end, lanes that are longer, whether counts enter then) of blocks, longest first."""
    ends = {int(n) for n in sizes}
    steps = [n for n in _STEPS if n < sizes[0]]
    at = 0
    for end in sorted(ends.union(steps)):
        yield at, end, int(np.count_nonzero(sizes >= end)), end in steps
        at = end


def _by_length(sizes: np.ndarray) -> np.ndarray:
    return np.argsort(-sizes, kind="stable")


def _places(ids: np.ndarray, table: np.ndarray):
    """The distinct ids by first use, each id's place among them, and whether it is new. ``table``: 65,536 words to write on."""
    n = np.arange(len(ids), dtype=np.uint16)
    table[ids[::-1]] = n[::-1]  # the first use is written last
    first = table.take(ids)
    new = first == n
    return ids[new], (np.cumsum(new, dtype=np.uint16) - np.uint16(1)).take(first), new


def _predicted(slots: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For (lane, step) arrays: the place last seen in the slot before, times 4, plus how often in a row (3 at most)."""
    lanes, steps = slots.shape
    key = (slots.astype(np.uint32) << 12) + np.arange(steps, dtype=np.uint32)
    key.sort(axis=1)
    order = (key & 4095).astype(np.int64) + np.arange(0, lanes * steps, steps)[:, None]
    place = places.ravel().take(order)
    known = np.zeros(slots.shape, bool)
    known[:, 1:] = (key[:, 1:] ^ key[:, :-1]) < 4096
    again = known.copy()
    again[:, 1:] &= place[:, 1:] == place[:, :-1]
    found = np.full(slots.shape, _EMPTY, np.uint16)
    run = again.astype(np.uint16) + np.uint16(1)
    run[:, 1:] += again[:, 1:] & again[:, :-1]
    found[:, 1:] = np.where(known[:, 1:], (place[:, :-1] << 2) + run[:, :-1], _EMPTY)
    out = np.empty_like(found)
    out.ravel()[order] = found
    return out


def _modelled(blocks: list[np.ndarray]):
    """Each block's distinct ids, and (step, lane) arrays: pairs of contexts, kinds, places inside a bucket."""
    longest, table, heads = len(blocks[0]), np.zeros(1 << 16, np.uint16), []
    pairs, kinds = (np.zeros((longest, len(blocks)), np.uint8) for _ in range(2))
    inside = np.zeros((longest, len(blocks)), np.uint16)
    for at in range(0, len(blocks), 32):
        some = blocks[at:at + 32]
        # one column before and two after: the places before the first id are 0
        places = np.zeros((len(some), len(some[0]) + 2), np.uint16)
        kind = np.zeros((len(some), len(some[0])), np.uint8)
        for i, b in enumerate(some):
            head, own, new = _places(b, table)
            heads.append(head)
            places[i, 2:len(b) + 2] = own
            kind[i, :len(b)] = np.where(new, np.uint8(_NEW), _KIND.take(own))
        last2, last1, place = places[:, :-2], places[:, 1:-1], np.ascontiguousarray(places[:, 2:])
        found2, found1 = (_predicted(s, place) for s in (_slot2(last2, last1), last1))
        kind[(found1 >> 2) == place] = _BY1
        kind[(found2 >> 2) == place] = _BY2
        n, to = place.shape[1], slice(at, at + len(some))
        pairs[:n, to] = (((found2 & 3) << 3) + ((found1 & 3) << 1) + ((found2 ^ found1) < 4)).T
        kinds[:n, to] = kind.T
        inside[:n, to] = np.where(kind > _NEW, place - _FIRST.astype(np.uint16).take(kind), 0).T
    return heads, pairs, kinds, inside


def _encode_lanes(blocks: list[np.ndarray]) -> list[bytes]:
    """Payloads of at most LANES blocks, longest first."""
    sizes = np.array([len(b) for b in blocks])
    heads, pairs, kinds, inside = _modelled(blocks)
    chances = _Chances(len(blocks))
    flat = chances.sums.ravel()
    start = np.arange(len(blocks)) * (len(blocks[0]) + 4)
    out, at = np.zeros(len(blocks) * (len(blocks[0]) + 4), np.uint32), start.copy()
    low, width = np.zeros(len(blocks)), np.full(len(blocks), float(1 << 48))
    counted = 0
    for begin, end, m, enter in _spans(sizes):
        lo, wide, to = low[:m], width[:m], at[:m]
        for t0 in range(begin, end, 16):
            some = np.s_[t0:min(t0 + 16, end), :m]
            kind = kinds[some]
            own = (chances.base[:m] + ((pairs[some].astype(np.int32) << 4) + kind)).astype(np.int64)
            below = flat.take(own)
            size = (flat.take(own + 1) - below) * _UNIT.take(kind)
            below = below.astype(float) * (1 << _REST) + inside[some] * size
            for start_t, size_t in zip(below, size):
                step = np.floor(wide * (1 / _TOTAL))
                lo += start_t * step
                np.multiply(size_t, step, out=wide)
                tight = wide < _LOW
                word = np.floor(lo * (1 / _LOW))  # with the carry
                out[to] = word.astype(np.uint32)  # written over unless it is settled
                to += tight
                lo -= word * tight * _LOW
                grow = np.where(tight, _WORD, 1.0)
                lo *= grow
                wide *= grow
        if enter:
            chances.count(*(x[counted:end, :m] for x in (pairs, kinds)))
            counted = end
    for _ in range(3):
        word = np.floor(low * (1 / _LOW))
        out[at] = word.astype(np.uint32)
        at += 1
        low = (low - word * _LOW) * _WORD
    payloads = []
    for head, a, b in zip(heads, start.tolist(), at.tolist()):
        words = out[a:b]
        while (over := words >> 16).any():
            words &= 0xFFFF
            words[:-1] += over[1:]
        payloads.append(b"".join([len(head).to_bytes(2, "little"), head.astype("<u2").tobytes(), words.astype("<u2").tobytes()]))
    return payloads


def _decode_lanes(payloads: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
    """Ids of at most LANES blocks, longest first."""
    lanes, longest = len(payloads), int(sizes[0])
    split = [(p, 2 + 2 * int.from_bytes(p[:2], "little")) for p in payloads]
    heads = [np.frombuffer(p[2:n], "<u2") for p, n in split]
    rest = [p[n:] for p, n in split]
    at = np.cumsum([0, *[len(r) // 2 for r in rest[:-1]]])
    words = np.frombuffer(b"".join([*rest, bytes(8)]), "<u2")
    code, width, known = np.zeros(lanes), np.full(lanes, float(1 << 48)), np.zeros(lanes, np.uint16)
    for _ in range(3):
        code = code * _WORD + words.take(at, mode="clip")
        at += 1
    next2, next1 = (np.full(lanes * _SLOTS, _EMPTY, np.uint16) for _ in range(2))
    chances, lane = _Chances(lanes), np.arange(lanes)
    chances_flat = chances.sums.ravel()
    last2, last1 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    first, unit = _FIRST.astype(float), _UNIT
    out = np.zeros((longest, lanes), np.uint16)
    seen, since = np.zeros((2, int(np.diff([0, *_STEPS, BLOCK]).max()), lanes), np.uint8), 0
    for begin, end, m, enter in _spans(sizes):
        co, wide, to, new_place, last2, last1 = code[:m], width[:m], at[:m], known[:m], last2[:m], last1[:m]
        slot0, row0 = lane[:m] * _SLOTS, lane[:m] * 32
        for t in range(begin, end):
            at2, at1 = _slot2(last2, last1), last1 + slot0
            at2 += slot0
            found2, found1 = next2.take(at2), next1.take(at1)
            sure2, sure1 = found2 & 3, found1 & 3
            pair = (sure2 << 3) + (sure1 << 1) + ((found2 ^ found1) < 4)
            row = row0 + pair
            sums = chances.sums.take(row, axis=0)
            step = np.floor(wide * (1 / _TOTAL))
            value = np.floor(co / step)
            np.minimum(value, _TOTAL - 1, out=value)  # beyond that only in damaged blocks
            top = (value * (1 / (1 << _REST))).astype(np.uint16)
            below = np.bitwise_count((sums <= top[:, None]).view(np.uint64))
            kind = (below[:, 0] + below[:, 1] - np.uint8(1)).astype(np.int64)
            row <<= 4
            row += kind
            start = chances_flat.take(row)
            row += 1
            size = (chances_flat.take(row) - start) * unit.take(kind)
            start = start * float(1 << _REST)
            value -= start
            value /= size
            inside = np.floor(value, out=value)
            start += inside * size
            start *= step
            co -= start
            np.multiply(size, step, out=wide)
            tight = wide < _LOW
            grow = np.where(tight, _WORD, 1.0)
            co *= grow
            co += words.take(to, mode="clip") * tight
            wide *= grow
            to += tight
            hit2, new = kind == _BY2, kind == _NEW
            inside += first.take(kind)
            place = inside.astype(np.uint16)  # 0 for kinds without a bucket
            place += new_place * new
            place += (found2 >> 2) * hit2
            place += (found1 >> 2) * (kind == _BY1)
            new_place += new
            fresh = (place << 2) + np.uint16(1)
            next2[at2] = fresh + np.minimum(sure2, 2) * hit2
            next1[at1] = fresh + np.minimum(sure1, 2) * ((found1 ^ fresh) < 4)
            last2, last1 = last1, place.astype(np.int64)
            out[t, :m] = place
            seen[0, since, :m], seen[1, since, :m] = pair, kind
            since += 1
        if enter:
            chances.count(*seen[:, :since, :m])
            since = 0
    out = np.ascontiguousarray(out.T)
    # only damaged blocks have places beyond their ids, or none
    return [h.take(out[i, :n], mode="clip") if len(h) else out[i, :n] for i, (h, n) in enumerate(zip(heads, sizes))]


def encode(blocks: list[np.ndarray]) -> list[tuple[bytes, int]]:
    """(payload, checksum) of each block of 1 to BLOCK ids. The checksum is the CRC-32 of the ids as 16-bit words."""
    out: list = [None] * len(blocks)
    order = _by_length(np.array([len(b) for b in blocks], np.int64))
    for at in range(0, len(order), LANES):
        some = order[at:at + LANES]
        for i, payload in zip(some, _encode_lanes([blocks[i] for i in some])):
            out[i] = payload, zlib.crc32(np.asarray(blocks[i], "<u2").tobytes())
    return out


class CorruptBlock(ValueError):
    """A block's ids do not have its checksum."""


def decode(coded: list[tuple[bytes, int]], sizes: list[int]) -> list[np.ndarray]:
    """The ids of each (payload, checksum), given the number of ids of each."""
    n = np.array(sizes, np.int64)
    out: list = [None] * len(coded)
    order = _by_length(n)
    for at in range(0, len(order), LANES):
        some = order[at:at + LANES]
        for i, ids in zip(some, _decode_lanes([coded[i][0] for i in some], n[some])):
            if zlib.crc32(ids.astype("<u2").tobytes()) != coded[i][1]:
                raise CorruptBlock(f"block {i}")
            out[i] = ids
    return out
