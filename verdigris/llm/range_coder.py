"""Token-id blocks by an adaptive context-mixing range coder.

Block format, all numbers little-endian: magic ``TKB2``, count of ids (4 bytes), crc32 of the ids as 4-byte numbers (4), size of the alphabet (4),
size of its part (4), the alphabet as ascending differences in 7-bit groups, then the coder's 16-bit words.  A block is decoded without any other one.

Every id is coded with one interval of [0, 65536).  Three predictors share it: what followed the last two ids the last time (order 2), what followed the last id
(order 1), and the frequencies of the ids so far (order 0).  The order-2 guess gets a part by how often guesses of its confidence have
come true, the order-1 guess such a part of the rest, and the remainder is dealt by the frequencies.  Parts and frequencies are taken anew after 64, 192, 576, ... ids, so
between two such places only the guesses change from id to id: the encoder, which knows all ids, computes all else for a stretch of places at once.
Blocks start from nothing.  Many blocks are coded side by side, a lane each, so every step is one set of numpy operations.

The coder keeps a 48-bit interval, in doubles, which hold such numbers exactly, and moves out 16 bits at a time, once a symbol at most; carries are added up at the end.
"""

from __future__ import annotations

import zlib

import numpy as np

MAGIC = b"TKB2"
#: Ids of a block.
BLOCK = 4096
#: Blocks coded side by side.
LANES = 2048
#: Total of the order-0 frequencies, more than a block's alphabet.
TOTAL_BITS = 13
TOTAL = 1 << TOTAL_BITS
#: Order-2 contexts of a lane, hashed.
SLOTS = 4096
#: Largest parts of the guesses, of 4096: the frequencies keep an eighth of the interval or more, so every id has a part.
MOST_2, MOST_1 = 3072, 2048
#: Parts at the start by confidence, worth PRIOR observations.
PART_2, PART_1, PRIOR = np.array([0, 512, 1024, 2048]), np.array([0, 256, 512, 1024]), 16
#: Places, and lanes, that are computed at once.
STRETCH, GROUP = 128, 16
#: Ids under this bound are numbered by a table.
DENSE = 1 << 17
#: What is added to 4 * symbol as a context's new state, by the old state xor (4 * symbol + 1), up to 4: confidence goes up while guesses come true, else it is 1.
_NEXT = np.array([2, 1, 3, 3, 1], np.uint16)
_HALF, _DOWN, _UP = float(1 << 32), 1 / 65536, 65536.0


class DamagedBlock(ValueError):
    """The block's bytes don't give the ids that its checksum was taken of."""


def _renewals(length: int) -> list[int]:
    """Places before which parts and frequencies are taken anew, from 0 on, and the end."""
    cuts, at = [0], 64
    while at < length:
        cuts.append(at)
        at *= 3
    return [*cuts, length]


def _frequencies(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """TOTAL dealt by the counts (..., lane, symbol); every id of the alphabet keeps 1 at least, the first takes what rounding leaves."""
    seen = np.maximum(counts.sum(-1, keepdims=True), 1)
    f = (counts * (TOTAL - sizes)[:, None].astype(np.float64) / seen).astype(np.int32)
    f += np.arange(counts.shape[-1]) < sizes[:, None]
    f[..., 0] += TOTAL - f.sum(-1, dtype=np.int32)
    return f


def _parts(tallies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of 65536, the parts of the order-2 and the order-1 guess by both confidences, (..., 16), from the outcomes so far, (..., 64)."""
    t = tallies.reshape(*tallies.shape[:-1], 4, 4, 4)
    part_2 = (t[..., 3].sum(-1) * 4096 + PART_2 * PRIOR) // (t.sum((-2, -1)) + PRIOR)
    part_1 = (t[..., 2].sum(-2) * 4096 + PART_1 * PRIOR) // (t[..., 1:3].sum((-3, -1)) + PRIOR)
    part_2, part_1 = np.clip(part_2, 32, MOST_2), np.clip(part_1, 32, MOST_1)
    part_2[..., 0] = part_1[..., 0] = 0
    a2 = np.repeat(part_2[..., :, None] << 4, 4, -1)
    a1 = (65536 - a2) * part_1[..., None, :] >> 12
    return a2.reshape(*a2.shape[:-2], 16), a1.reshape(*a1.shape[:-2], 16)


def _outcomes(s: np.ndarray, v1: np.ndarray, v2: np.ndarray) -> np.ndarray:
    """4 * (4 * confidence of order 2 + that of order 1) + 3 where the order-2 guess came true, 2 where that of order 1 did, 1 where its part was lost, 0 without one.
    A context's state v is 4 * guess + confidence; confidence 0: nothing seen."""
    four = s << 2
    x1, x2, c1, c2 = v1 ^ four, v2 ^ four, v1 & 3, v2 & 3
    second = (x2 < 4) & (c2 > 0)
    one = (c1 > 0) & (((v1 ^ v2) > 3) | (c2 == 0))
    end = one.view(np.uint8) + (one & (x1 < 4)).view(np.uint8)
    end[second] = 3
    return (((c2 << 2) | c1) << 2) + end


def _states(context: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The state of each place's context before its symbol is known, a row for each lane: equal contexts of a lane are brought together in order."""
    lanes, places = s.shape
    at = (np.argsort(context, axis=1, kind="stable") + (np.arange(lanes) * places)[:, None]).ravel()
    key, x = context.ravel()[at], s.ravel()[at]
    again, hit = np.zeros(len(at), bool), np.zeros(len(at), bool)
    again[1:] = key[1:] == key[:-1]
    again[::places] = False
    hit[1:] = again[1:] & (x[1:] == x[:-1])
    sure = np.ones(len(at), np.uint16)
    sure[1:] += hit[:-1]
    sure[2:] += hit[1:-1] & hit[:-2]
    v = np.zeros(len(at), np.uint16)
    v[1:] = (x[:-1] << 2) + sure[1:]
    v *= again
    out = np.empty(len(at), np.uint16)
    out[at] = v
    return out.reshape(lanes, places)


def _intervals(symbols: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the symbol of each place, for some lanes."""
    lanes, places = symbols.shape
    prior = np.zeros((2, lanes, places), np.uint16)
    prior[0, :, 1:], prior[1, :, 2:] = symbols[:, :-1], symbols[:, :-2]
    v1 = _states(prior[0], symbols)
    v2 = _states(((prior[1].astype(np.uint32) * 40503 + prior[0].astype(np.uint32) * 2531) & (SLOTS - 1)).astype(np.uint16), symbols)
    cuts, width = _renewals(places), int(sizes.max())
    periods = len(cuts) - 1
    period = np.repeat(np.arange(periods), np.diff(cuts)) * lanes + np.arange(lanes)[:, None]
    outcome = _outcomes(symbols, v1, v2)
    ended, at = outcome + period * 64, symbols + period * width
    if lengths.min() < places:
        inside = np.arange(places) < lengths[:, None]
        ended, at = ended[inside], at[inside]
    before = lambda x, n: np.concatenate([np.zeros((1, lanes, n), np.int64), np.bincount(x.ravel(), minlength=periods * lanes * n).reshape(periods, lanes, n).cumsum(0)[:-1]])
    cum = np.zeros((periods, lanes, width + 1), np.int32)
    np.cumsum(_frequencies(before(at, width), sizes), axis=2, out=cum[:, :, 1:])
    part_2, part_1 = (x.astype(np.int32).ravel() for x in _parts(before(ended, 64)))
    at = period * 16 + (outcome >> 2)
    end = outcome & 3
    a2, a1 = part_2.take(at), part_1.take(at)
    a1 *= ((v1 ^ v2) > 3) | ((v2 & 3) == 0)
    both = a2 + a1
    rest = 65536 - both
    at = symbols + period * (width + 1)
    low = cum.take(at) * rest >> TOTAL_BITS
    size = (cum.take(at + 1) * rest >> TOTAL_BITS) - low
    low += both
    second, first = end == 3, end == 2
    np.copyto(low, a2, where=first)
    np.copyto(size, a1, where=first)
    np.copyto(low, 0, where=second)
    np.copyto(size, a2, where=second)
    return low, size


def _varints(x: np.ndarray) -> bytes:
    """Numbers in groups of 7 bits, low ones first, all but the last with the high bit."""
    size = 1 + sum((x >= 1 << bits).astype(np.int64) for bits in (7, 14, 21, 28))
    ends = np.cumsum(size)
    group = np.arange(int(size.sum())) - np.repeat(ends - size, size)
    out = np.repeat(x, size) >> 7 * group & 127 | 128
    out[ends - 1] &= 127
    return out.astype(np.uint8).tobytes()


def _unvarints(data: bytes, n: int) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    ends = np.flatnonzero(b < 128)
    if len(ends) != n or (n and ends[-1] != len(b) - 1) or (not n and len(b)):
        raise DamagedBlock("alphabet")
    if not n:
        return np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    group = np.arange(len(b)) - np.repeat(starts, ends + 1 - starts)
    return np.add.reduceat((b & 127) << 7 * np.minimum(group, 8), starts)


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """The coded form of each array of ids."""
    out: list[bytes] = [b""] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    for at in range(0, len(order), LANES):
        for i, data in zip(order[at : at + LANES], _encode([blocks[i] for i in order[at : at + LANES]]), strict=True):
            out[i] = data
    return out


def _numbered(ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in ascending order, and the place of each id among them; places: room for DENSE numbers."""
    if len(ids) and int(ids.max()) >= DENSE:
        return np.unique(ids, return_inverse=True)
    used = np.zeros(int(ids.max(initial=0)) + 1, bool)
    used[ids] = True
    letters = np.flatnonzero(used)
    places[letters] = np.arange(len(letters))
    return letters, places[ids]


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Blocks in descending length, all at once."""
    lengths = np.array([len(b) for b in blocks])
    longest, lanes = int(lengths.max(initial=0)), len(blocks)
    alphabets, symbols, places = [], np.zeros((lanes, longest), np.uint16), np.zeros(DENSE, np.uint16)
    for i, b in enumerate(blocks):
        letters, index = _numbered(np.asarray(b, np.int64), places)
        alphabets.append(letters)
        symbols[i, : len(b)] = index
    if not longest:
        return [_framed(b, a, b"") for b, a in zip(blocks, alphabets, strict=True)]
    sizes = np.array([max(1, len(a)) for a in alphabets])
    # some places more, so that a place of all lanes does not fall into few sets of the cache
    starts, shares = np.zeros((lanes, longest + 24), np.int32), np.zeros((lanes, longest + 24), np.int32)
    for i in range(0, lanes, GROUP):
        some = slice(i, i + GROUP)
        width = int(lengths[i])
        if width:
            starts[some, :width], shares[some, :width] = _intervals(symbols[some, :width], sizes[some], lengths[some])
    low, span = np.zeros(lanes), np.full(lanes, float((1 << 48) - 1))
    words = np.zeros((lanes, longest + 4), np.int32)
    flat, put = words.ravel(), np.arange(lanes) * words.shape[1]
    n = lanes
    for since in range(0, longest, STRETCH):
        start, share = (np.ascontiguousarray(x[:, since : min(longest, since + STRETCH)].T) for x in (starts, shares))
        for t in range(len(start)):
            if lengths[n - 1] <= since + t:
                n = int(np.searchsorted(-lengths, -(since + t), "left"))
            lo, sp = low[:n], span[:n]
            unit = sp * _DOWN
            np.floor(unit, out=unit)
            np.multiply(share[t, :n], unit, out=sp)
            unit *= start[t, :n]
            lo += unit
            out = (sp < _HALF).nonzero()[0]
            here, there = lo.take(out), put.take(out)
            word = np.floor(here * (1 / _HALF))
            flat[there] = word
            put[out] = there + 1
            lo[out] = (here - word * _HALF) * _UP
            sp[out] = sp.take(out) * _UP
    for _ in range(3):
        word = np.floor(low * (1 / _HALF))
        flat[put] = word
        put += 1
        low = (low - word * _HALF) * _UP
    used = put - np.arange(lanes) * words.shape[1]
    while (over := words >> 16).any():
        words &= 0xFFFF
        words[:, :-1] += over[:, 1:]
    return [_framed(b, a, words[i, : used[i]].astype("<u2").tobytes()) for i, (b, a) in enumerate(zip(blocks, alphabets, strict=True))]


def _framed(ids: np.ndarray, letters: np.ndarray, words: bytes) -> bytes:
    alphabet = _varints(np.diff(letters, prepend=0))
    head = np.array([len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()), len(letters), len(alphabet)], "<u4").tobytes()
    return MAGIC + head + alphabet + words


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each coded block; DamagedBlock if one is not whole."""
    heads = []
    for b in blocks:
        if b[:4] != MAGIC or len(b) < 20:
            raise DamagedBlock("magic")
        heads.append(np.frombuffer(b, "<u4", 4, 4).tolist())
    out: list = [None] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda i: -heads[i][0])
    for at in range(0, len(order), LANES):
        group = order[at : at + LANES]
        for i, ids in zip(group, _decode([blocks[i] for i in group], [heads[i] for i in group]), strict=True):
            if zlib.crc32(ids.tobytes()) != heads[i][1]:
                raise DamagedBlock("checksum")
            out[i] = ids
    return out


def _decode(blocks: list[bytes], heads: list[list[int]]) -> list[np.ndarray]:
    lengths = np.array([h[0] for h in heads])
    if any(h[2] > TOTAL or (h[0] and not h[2]) for h in heads):
        raise DamagedBlock("alphabet")
    steps = _unvarints(b"".join([b[20 : 20 + h[3]] for b, h in zip(blocks, heads, strict=True)]), sum(h[2] for h in heads))
    letters = [np.cumsum(x) for x in np.split(steps, np.cumsum([h[2] for h in heads])[:-1])]
    longest = int(lengths.max(initial=0))
    if not longest:
        return [np.zeros(0, "<u4") for _ in blocks]
    coded = [np.frombuffer(b[20 + h[3] :][: (len(b) - 20 - h[3]) // 2 * 2], "<u2") for b, h in zip(blocks, heads, strict=True)]
    words = np.zeros((len(blocks), max(map(len, coded)) + 4), np.uint16)
    for i, w in enumerate(coded):
        words[i, : len(w)] = w
    lanes = len(blocks)
    sizes = np.array([max(1, len(a)) for a in letters])
    symbols, v1, v2 = np.zeros((longest, lanes), np.uint16), np.zeros((longest, lanes), np.uint16), np.zeros((longest, lanes), np.uint16)
    flat, put = words.ravel(), np.arange(lanes) * words.shape[1] + 3
    # a damaged block's words may end before its ids do: zeros or another lane's words are read then, and the checksum tells
    code = words[:, 0] * _HALF + words[:, 1] * _UP + words[:, 2]
    span = np.full(lanes, float((1 << 48) - 1))
    lane, width = np.arange(lanes), int(sizes.max())
    offset_1, offset_2, offset_p, offset_t = 4 * lane * width, lane * SLOTS, lane * 16, lane * TOTAL
    seen_2 = np.zeros(lanes * SLOTS, np.uint16)
    # side by side for each symbol: its state as a context, where its frequency starts, and how much that is
    records = np.zeros((lanes, width, 4), np.uint16)
    record = records.ravel()
    counts, tallies = np.zeros((lanes, width), np.int64), np.zeros((lanes, 64), np.int64)
    table = np.zeros((lanes, TOTAL), np.uint16)
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)  # the last symbol, and the part of the hash of the one before it
    cuts, n, past = _renewals(longest), lanes, 0
    for since, end in zip(cuts, cuts[1:], strict=False):
        for i in range(0, lanes, GROUP):
            some = slice(i, i + GROUP)
            _counted(counts[some], tallies[some], symbols[past:since, some], v1[past:since, some], v2[past:since, some], lengths[some] - past)
            f = _frequencies(counts[some], sizes[some])
            records[some, :, 1], records[some, :, 2] = np.cumsum(f, axis=1) - f, f
            table[some] = np.repeat(np.tile(np.arange(width, dtype=np.uint16), len(f)), f.ravel()).reshape(-1, TOTAL)
        part_2, part_1 = (x.astype(np.float64).ravel() for x in _parts(tallies))
        past, dealt = since, table.ravel()
        for t in range(since, end):
            if lengths[n - 1] <= t:
                n = int(np.searchsorted(-lengths, -t, "left"))
                last, before = last[:n], before[:n]
            s_1, s_2, sp, co = v1[t, :n], v2[t, :n], span[:n], code[:n]
            at_1 = (last << 2) + offset_1[:n]
            then = last * 40503
            last *= 2531
            last += before
            last &= SLOTS - 1
            last += offset_2[:n]
            at_2 = last
            record.take(at_1, out=s_1, mode="clip")
            seen_2.take(at_2, out=s_2, mode="clip")
            c2 = s_2 & 3
            at = offset_p[:n] + ((c2 << 2) | (s_1 & 3))
            a2, both = part_2.take(at), part_1.take(at)
            both *= ((s_1 ^ s_2) > 3) | (c2 == 0)
            both += a2
            unit = sp * _DOWN
            np.floor(unit, out=unit)
            value = co / unit
            np.floor(value, out=value)
            second, guessed = value < a2, value < both
            rest = 65536 - both
            value -= both
            np.clip(value, 0, 65535 - both, out=value)
            value *= TOTAL
            value += TOTAL - 1
            value /= rest
            at = value.astype(np.int64)
            at += offset_t[:n]
            # a guess's id may also lie in the part dealt by frequency, but the encoder never uses that
            s = dealt.take(at)
            one = guessed.nonzero()[0]
            took = second.take(one)
            s[one] = np.where(took, s_2.take(one), s_1.take(one)) >> 2
            four = s << 2
            rest *= 1 / TOTAL
            at = four + offset_1[:n]
            at += 1
            low = record.take(at)
            at += 1
            high = (record.take(at) + low) * rest
            low = low * rest
            np.floor(low, out=low)
            np.floor(high, out=high)
            high -= low
            low += both
            a2 = a2.take(one)
            low[one] = np.where(took, 0, a2)
            high[one] = np.where(took, a2, both.take(one) - a2)
            low *= unit
            co -= low
            np.multiply(high, unit, out=sp)
            out = (sp < _HALF).nonzero()[0]
            there = put.take(out)
            co[out] = co.take(out) * _UP + flat.take(there, mode="clip")
            put[out] = there + 1
            sp[out] = sp.take(out) * _UP
            symbols[t, :n] = s
            mark = four | 1
            record[at_1] = four + _NEXT.take(s_1 ^ mark, mode="clip")
            seen_2[at_2] = four + _NEXT.take(s_2 ^ mark, mode="clip")
            before = then
            last = s.astype(np.int64)
    rows = np.ascontiguousarray(symbols.T)
    return [a[rows[i, :n]].astype("<u4") if n else np.zeros(0, "<u4") for i, (a, n) in enumerate(zip(letters, lengths.tolist(), strict=True))]


def _counted(counts: np.ndarray, tallies: np.ndarray, s: np.ndarray, v1: np.ndarray, v2: np.ndarray, lengths: np.ndarray) -> None:
    """Add the symbols and the outcomes of a period of some lanes, a row for each place."""
    if not len(s):
        return
    s, v1, v2 = (np.ascontiguousarray(x.T) for x in (s, v1, v2))
    lane = np.arange(len(s))[:, None]
    at, ended = s + lane * counts.shape[1], _outcomes(s, v1, v2) + lane * 64
    if lengths.min() < s.shape[1]:
        inside = np.arange(s.shape[1]) < lengths[:, None]
        at, ended = at[inside], ended[inside]
    counts += np.bincount(at.ravel(), minlength=counts.size).reshape(counts.shape)
    tallies += np.bincount(ended.ravel(), minlength=tallies.size).reshape(tallies.shape)


def _times(a: int, b: int) -> int:
    """Product of polynomials over GF(2) modulo that of crc32, reflected."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


#: x to the power 8 * 2**k.
_POWERS = [1 << 23]
while len(_POWERS) < 48:
    _POWERS.append(_times(_POWERS[-1], _POWERS[-1]))


def crc_joined(first: int, second: int, size: int) -> int:
    """crc32 of two pieces one after the other, the second of ``size`` bytes."""
    for k, power in enumerate(_POWERS):
        if size >> k & 1:
            first = _times(power, first)
    return first ^ second
