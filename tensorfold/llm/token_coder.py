"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A block holds up to ``BLOCK`` ids, starts from an empty model, and carries the CRC-32 of its ids and the list of its
distinct ids, whose places in that list are what is coded. The probability of a place mixes three models: order 2
and order 1 name the place that last followed the last two ids and the last one, each with a confidence that grows
while it is right; order 0 holds the counts of all places so far. How the three share the probability is learnt for
each pair of confidences. Order 2 and 1 learn from every id, counts and shares at the points of ``POINTS``.

Blocks don't depend on each other, so numpy codes thousands in lockstep, one id of each at a time. Whatever decides
about bits is an integer or one correctly rounded product, so what is read is what was written on any machine.
Little-endian format of a group of blocks, whose distinct ids together are its alphabet:

    uint32 ids, blocks, ids of a block (the last may have fewer), letters, bytes of the alphabet, bytes of the lists,
    words of code
    alphabet: the gaps between its letters; lists: the gaps between each block's places in the alphabet; both in Rice
    code: uint32 low bits k, uint32 bytes of the unary part, that part as bits, then the low bits
    by block: uint32 CRC-32 of the ids as uint32, uint16 places, uint16 words of code
    uint32 words of code, block after block
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

BLOCK = 2048
#: Blocks coded in lockstep at once.
LANES = 4096
#: After how many ids counts and shares are taken anew.
POINTS = (128, 384, 1024)
#: Order 0 and the shares each are of 2**12; a place needs 2 more bits for its confidence.
_BITS, _SURE = 12, 3
_TOTAL = 1 << _BITS
_SLOT_BITS = 11
_SLOTS = 1 << _SLOT_BITS
_MASK = np.int64(_SLOTS - 1)
#: The window of 63 bits and the words of 32 that leave it.
_LOW_WORD, _31, _32 = np.uint64((1 << 31) - 1), np.uint64(31), np.uint64(32)
_LEAST = np.uint64(1 << 31)
_WORD = np.uint64((1 << 32) - 1)
_STEP = np.uint64(2 * _BITS)
#: So that a sum that rounding left just below a whole number counts as that.
_ROUND = 1e-6
_HEAD = struct.Struct("<7I")


def _first_shares() -> np.ndarray:
    """Counts to begin with by confidences of order 2 and 1, then outcome: order 2 right, order 1 right, neither."""
    counts = np.zeros((_SURE + 1, _SURE + 1, 3))
    for two in range(_SURE + 1):
        for one in range(_SURE + 1):
            counts[two, one] = (two if two else 0, one * 0.5 if one else 0, 4)
    return counts.reshape(-1, 3)


_SHARES = _first_shares()
_CONTEXTS = len(_SHARES)
_POSSIBLE = _SHARES > 0


class _Model:
    """The state of all lanes; ``sizes`` are the numbers of places of their blocks."""

    def __init__(self, sizes: np.ndarray):
        lanes = len(sizes)
        self.sizes, self.width = sizes, int(sizes.max())
        lane = np.arange(lanes)
        self.row0, self.row2, self.row_shares = lane * self.width, lane * _SLOTS, lane * (4 * _CONTEXTS)
        self.one, self.two = np.zeros(lanes * self.width, np.int16), np.zeros(lanes * _SLOTS, np.int16)
        self.last = self.before = np.zeros(lanes, np.int64)
        self.counts = np.where(np.arange(self.width) < sizes[:, None], 1.0, 0.0)
        self.outcomes = np.tile(_SHARES, (lanes, 1, 1))
        self.places, self.seen = [], []
        self.settle()

    def settle(self) -> None:
        """Take the counts and shares of the ids so far."""
        lanes = len(self.sizes)
        if self.places:
            miss = np.concatenate(self.places)
            self.counts += 2.0 * np.bincount(miss, minlength=self.counts.size + 1)[:-1].reshape(self.counts.shape)
            self.outcomes += np.bincount(np.concatenate(self.seen), minlength=lanes * 4 * _CONTEXTS).reshape(lanes, _CONTEXTS, 4)[:, :, :3]
            self.places, self.seen = [], []
        # Every place keeps one part; the others go by counts.
        total = np.cumsum(self.counts, axis=1)
        upto = np.minimum(np.arange(1, self.width + 1), self.sizes[:, None])
        cum = np.zeros((lanes, self.width + 1), np.int64)
        cum[:, 1:] = upto + np.floor(total * ((_TOTAL - self.sizes) / total[:, -1])[:, None] + _ROUND).astype(np.int64)
        self.freq = np.diff(cum, axis=1)
        #: By lane and place: first part and parts; the last item stands for a place that another order has named.
        self.parts = np.append(((cum[:, :-1] << _BITS + 1) | self.freq).ravel(), _TOTAL).astype(np.uint32)
        shares = np.cumsum(self.outcomes, axis=2)
        least = np.cumsum(_POSSIBLE, axis=1)
        bound = np.zeros((lanes, _CONTEXTS, 4), np.int64)
        bound[:, :, 1:] = least + np.floor(shares * ((_TOTAL - least[:, -1]) / shares[:, :, -1])[:, :, None] + _ROUND).astype(np.int64)
        #: By lane, confidences and outcome: first part and parts.
        self.share = np.zeros((lanes, _CONTEXTS, 4), np.uint64)
        self.share[:, :, :3] = (bound[:, :, :3] << _BITS + 1) | np.diff(bound, axis=2)
        self.share = self.share.ravel()
        self.bounds = bound[:, :, 1].astype(np.int32).ravel(), bound[:, :, 2].astype(np.int32).ravel()

    def slots(self) -> np.ndarray:
        """By lane and part of order 0, the place."""
        return np.repeat(np.tile(np.arange(self.width, dtype=np.uint16), len(self.sizes)), self.freq.ravel())

    def predict(self) -> None:
        """What orders 2 and 1 name and how sure they are, and where that is kept (place plus one, and two bits)."""
        self.at1 = self.row0 + self.last
        self.at2 = (self.last * 2971 + self.before * 40503 >> 2 & _MASK) + self.row2
        two, one = self.two.take(self.at2), self.one.take(self.at1)
        # An order that has nothing to say names -1.
        self.two_names, self.one_names = (two >> 2) - 1, (one >> 2) - 1
        self.sure2, self.sure1 = two & 3, one & 3
        self.context = self.row_shares + ((self.sure2 << 2 | self.sure1) << 2)

    def learn(self, x: np.ndarray, right2: np.ndarray, right1: np.ndarray, outcome: np.ndarray, place: np.ndarray) -> None:
        """``right2`` and ``right1`` are 1 where an order has named x."""
        new = ((x << 2) + 5).astype(np.int16)
        self.two[self.at2] = new + np.minimum(self.sure2, 2) * right2
        self.one[self.at1] = new + np.minimum(self.sure1, 2) * right1
        self.seen.append(outcome)
        self.places.append(place)
        self.before, self.last = self.last, x


def _encode(places: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, words of each lane): ``places`` is (ids of a block, lanes)."""
    steps, lanes = places.shape
    width = steps * 2 * _BITS // 32 + 4
    out, pos = np.zeros(lanes * width, np.uint32), np.arange(lanes) * width
    start = pos.copy()
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 63, np.uint64)
    model = _Model(sizes)
    hit, mask = len(model.parts) - 1, np.uint64(2 * _TOTAL - 1)
    shift, bits = np.uint64(_BITS + 1), np.uint64(_BITS)

    def carry(at: np.ndarray) -> None:
        while len(at):
            at = at - 1
            out[at] += np.uint32(1)
            at = at[out[at] == 0]

    for t in range(steps):
        if t in POINTS:
            model.settle()
        x = places[t].astype(np.int64)
        model.predict()
        right2, right1 = model.two_names == x, model.one_names == x
        missed = ~(right2 | right1)
        outcome = model.context + (missed.view(np.int8) - right2.view(np.int8) + np.int8(1))
        place = np.where(missed, model.row0 + x, hit)
        share, own = model.share.take(outcome), model.parts.take(place).astype(np.uint64)
        part = span >> _STEP
        parts = share & mask
        low += (((share >> shift) << bits) + parts * (own >> shift)) * part
        span = part * (parts * (own & mask))
        need = np.flatnonzero(span < _LEAST)
        if len(need):
            l, at = low.take(need), pos.take(need)
            word = l >> _31
            out[at] = word.astype(np.uint32)
            pos[need] = at + 1
            over = np.flatnonzero(word > _WORD)
            if len(over):
                carry(at[over])
            low[need] = (l & _LOW_WORD) << _32
            span[need] <<= _32
        model.learn(x, right2, right1, outcome, place)
    word = low >> _31
    out[pos] = word.astype(np.uint32)
    carry(pos[word > _WORD])
    out[pos + 1] = ((low & _LOW_WORD) << np.uint64(1)).astype(np.uint32)
    lengths = pos + 2 - start
    keep = np.arange(width) < lengths[:, None]
    return out.reshape(lanes, width)[keep], lengths


def _decode(words: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, steps: int) -> np.ndarray:
    """The places, (ids of a block, lanes), of what ``_encode`` gave."""
    lanes = len(lengths)
    words = np.concatenate([words, np.zeros(2, np.uint32)]).astype(np.uint64)
    pos = np.cumsum(lengths) - lengths
    value = words[pos] << _31 | words[pos + 1] >> np.uint64(1)
    # Words as they lie after the first 63 bits.
    ahead = (words[:-1] & np.uint64(1)) << _31 | words[1:] >> np.uint64(1)
    pos += 1
    span, out = np.full(lanes, 1 << 63, np.uint64), np.zeros((steps, lanes), np.uint16)
    model = _Model(sizes)
    slots, row_slots = model.slots(), np.arange(lanes) * _TOTAL
    hit, mask, most = len(model.parts) - 1, np.uint64(2 * _TOTAL - 1), np.uint64(_TOTAL * _TOTAL - 1)
    shift, bits = np.uint64(_BITS + 1), np.uint64(_BITS)
    for t in range(steps):
        if t in POINTS:
            model.settle()
            slots = model.slots()
        model.predict()
        part = span >> _STEP
        v = np.minimum(value // part, most)
        flag, context = (v >> bits).astype(np.int32), model.context >> 2
        missed = flag >= model.bounds[1].take(context)
        outcome = model.context + ((flag >= model.bounds[0].take(context)).astype(np.int64) + missed)
        share = model.share.take(outcome)
        parts, first = share & mask, share >> shift << bits
        # Both are small integers: the quotient's whole part is exact.
        inner = ((v - first).astype(np.float64) / parts.astype(np.float64)).astype(np.int64)
        x = slots.take(row_slots + inner).astype(np.int64)
        x = np.where(missed, x, np.where(outcome == model.context, model.two_names, model.one_names))
        place = np.where(missed, model.row0 + x, hit)
        own = model.parts.take(place).astype(np.uint64)
        value -= (first + parts * (own >> shift)) * part
        span = part * (parts * (own & mask))
        need = np.flatnonzero(span < _LEAST)
        if len(need):
            at = pos.take(need)
            value[need] = value.take(need) << _32 | ahead.take(at)
            pos[need] = at + 1
            span[need] <<= _32
        out[t] = x
        model.learn(x, model.two_names == x, model.one_names == x, outcome, place)
    return out


def _rice(gaps: np.ndarray) -> bytes:
    """Non-negative numbers in Rice code, with what tells how to read them."""
    k = max(0, int(np.log2(gaps.mean() + 1e-9))) if len(gaps) and gaps.mean() > 1 else 0
    ends = np.cumsum((gaps >> k) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    head = np.packbits(unary).tobytes()
    low = (gaps[:, None] >> np.arange(k) & 1).astype(np.uint8)
    return struct.pack("<II", k, len(head)) + head + np.packbits(low.ravel()).tobytes()


def _unrice(data: bytes, n: int) -> np.ndarray:
    k, size = struct.unpack_from("<II", data)
    if k > 32 or 8 + size + -(-n * k // 8) != len(data):
        raise ValueError("a list of ids is damaged")
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, 8)))[:n]
    low = np.unpackbits(np.frombuffer(data, np.uint8, -1, 8 + size), count=n * k).reshape(n, k).astype(np.int64)
    if len(ends) != n:
        raise ValueError("a list of ids is damaged")
    return (np.diff(ends, prepend=-1) - 1 << k) + (low << np.arange(k)).sum(axis=1)


def _letters(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids ascending, the ids' places among them)."""
    most = int(ids.max())
    if most >= 1 << 24:
        letters, places = np.unique(ids, return_inverse=True)
        return letters, places
    there = np.zeros(most + 1, bool)
    there[ids] = True
    letters = np.flatnonzero(there)
    place = np.zeros(most + 1, np.int32)
    place[letters] = np.arange(len(letters))
    return letters, place.take(ids)


def pack_group(ids: np.ndarray) -> bytes:
    """At most ``BLOCK * LANES`` ids below 2**32, at least one, as one group."""
    n = len(ids)
    steps = min(BLOCK, n)
    lanes = -(-n // steps)
    letters, at = _letters(ids)
    k = len(letters)
    # What the last block lacks is filled up with an id it has.
    if lanes * steps > n:
        at = np.concatenate([at, np.full(lanes * steps - n, at[-1], at.dtype)])
    at = at.reshape(lanes, steps)
    places, gaps, sizes = np.zeros((steps, lanes), np.uint16), [], np.zeros(lanes, np.int64)
    chunk = max(1, (1 << 24) // k)
    for lo in range(0, lanes, chunk):
        part = at[lo : lo + chunk]
        cell = (part + (np.arange(len(part)) * k)[:, None]).T.ravel()
        there = np.zeros(len(part) * k, bool)
        there[cell] = True
        found = np.flatnonzero(there)
        size = np.bincount(found // k, minlength=len(part))
        begin = np.cumsum(size) - size
        place = np.zeros(len(part) * k, np.uint16)
        place[found] = np.arange(len(found)) - np.repeat(begin, size)
        places[:, lo : lo + len(part)] = place.take(cell).reshape(steps, -1)
        gap = np.diff(found, prepend=-1) - 1
        gap[begin] = found[begin] % k
        gaps.append(gap)
        sizes[lo : lo + len(part)] = size
    words, lengths = _encode(places, sizes)
    lists = _rice(np.concatenate(gaps))
    blocks = np.zeros(lanes, [("crc", "<u4"), ("places", "<u2"), ("words", "<u2")])
    data = ids.astype("<u4")
    blocks["crc"] = [zlib.crc32(data[i : i + steps]) for i in range(0, n, steps)]
    blocks["places"], blocks["words"] = sizes, lengths
    alphabet = _rice(np.diff(letters.astype(np.int64), prepend=-1) - 1)
    return b"".join([_HEAD.pack(n, lanes, steps, k, len(alphabet), len(lists), len(words)), alphabet, lists, blocks.tobytes(), words.astype("<u4").tobytes()])


def group_size(head: bytes) -> int:
    """The bytes of a group that follow its head."""
    _, lanes, _, _, alphabet, lists, words = _HEAD.unpack(head)
    return alphabet + lists + 8 * lanes + 4 * words


def unpack_group(head: bytes, body: bytes) -> np.ndarray:
    """The ids of a group; every block is compared with its checksum."""
    n, lanes, steps, k, alphabet, lists, count = _HEAD.unpack(head)
    if len(body) != group_size(head):
        raise ValueError("a group isn't as long as it says")
    letters = np.cumsum(_unrice(body[:alphabet], k) + 1) - 1
    at = alphabet + lists
    blocks = np.frombuffer(body, [("crc", "<u4"), ("places", "<u2"), ("words", "<u2")], lanes, at)
    sizes, lengths = blocks["places"].astype(np.int64), blocks["words"].astype(np.int64)
    gaps = _unrice(body[alphabet:at], int(sizes.sum()))
    words = np.frombuffer(body, "<u4", count, at + 8 * lanes)
    if lengths.sum() != count or not sizes.all() or not lengths.all() or (sizes > _TOTAL).any():
        raise ValueError("a group's blocks don't fit it")
    begin = np.cumsum(sizes) - sizes
    upto = np.cumsum(gaps + 1)
    found = upto - 1 - np.repeat(upto[begin] - gaps[begin] - 1, sizes)
    if (found >= k).any():
        raise ValueError("a list of ids is damaged")
    try:
        places = _decode(words, lengths, sizes, steps)
    except IndexError as e:
        raise ValueError("a group's code leads nowhere") from e
    ids = letters.astype(np.uint32)[found].take(begin[:, None] + np.minimum(places.T, sizes[:, None] - 1)).ravel()[:n]
    for i, crc in zip(range(0, n, steps), blocks["crc"].tolist()):
        if zlib.crc32(ids[i : i + steps]) != crc:
            raise ValueError("a block's ids don't have its checksum")
    return ids


def pack(ids: np.ndarray) -> Iterator[bytes]:
    """The groups of a run of ids below 2**32."""
    for lo in range(0, len(ids), BLOCK * LANES):
        yield pack_group(ids[lo : lo + BLOCK * LANES])


def unpack(stream, end: int) -> Iterator[np.ndarray]:
    """The ids of one group after another, from where a seekable stream is up to the byte ``end``."""
    while stream.tell() < end:
        head = stream.read(_HEAD.size)
        if len(head) < _HEAD.size:
            raise ValueError("a group was cut off")
        yield unpack_group(head, stream.read(group_size(head)))
