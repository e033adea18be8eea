"""Lossless WebP (VP8L) images: a complete decoder, and an encoder that can use every tool the decoder undoes.

Pixels are arrays of height x width ARGB words (uint32). Bits are read and written by whole arrays: the decoder looks
up what each bit position would decode to and then follows the chain of positions; only the chain is a Python loop.
"""

from __future__ import annotations

import struct

import numpy as np

U32, U64 = np.uint32, np.uint64
MAX_SIDE = 1 << 14
LENGTH_CODES, DISTANCE_CODES = 24, 40
MAX_BITS = 15
#: Fixed values of the format: the order in which lengths of the code length code are stored, and the cache's multiplier.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
CACHE_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


def near_offsets() -> list[tuple[int, int]]:
    """(x, y) of the 120 short distance codes: pixels to the left and above, nearest first."""
    found = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(found, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


NEAR = near_offsets()


class BadImage(ValueError):
    """The bytes are not a lossless WebP image."""


# ---------------------------------------------------------------- bits


def pack_bits(values: np.ndarray, sizes: np.ndarray) -> tuple[bytes, int]:
    """Little-endian bit string of fields of at most 64 bits, and its length in bits."""
    total = int(sizes.sum())
    at = np.cumsum(sizes) - sizes
    word, shift = at >> 6, (at & 63).astype(U64)
    out = np.zeros((total >> 6) + 2, U64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
    over = np.flatnonzero((at & 63) + sizes > 64)
    out[word[over] + 1] |= values[over] >> U64(1) >> (U64(63) - shift[over])
    return out.tobytes(), total


class BitWriter:
    def __init__(self):
        self.bits, self.size = 0, 0

    def put(self, value: int, size: int) -> None:
        self.bits |= value << self.size
        self.size += size

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        if len(values):
            raw, total = pack_bits(values.astype(U64), sizes)
            self.put(int.from_bytes(raw, "little"), total)

    def bytes(self) -> bytes:
        return self.bits.to_bytes((self.size + 7) >> 3, "little")


class BitReader:
    """windows[p]: the 32 bits from bit p on; bits after the end read as zero."""

    def __init__(self, data: bytes):
        self.end = 8 * len(data)
        b = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(16, np.uint8)]).astype(U64)
        n = len(data) + 8
        word = b[:n] | b[1 : n + 1] << U64(8) | b[2 : n + 2] << U64(16) | b[3 : n + 3] << U64(24) | b[4 : n + 4] << U64(32)
        self.windows = ((word[:, None] >> np.arange(8, dtype=U64)) & U64(0xFFFFFFFF)).astype(U32).ravel()
        self.view = memoryview(self.windows)
        self.at = 0

    def get(self, size: int) -> int:
        if self.at + size > self.end:
            raise BadImage("the image ends early")
        got = self.view[self.at] & ((1 << size) - 1)
        self.at += size
        return got


# ---------------------------------------------------------------- prefix codes

_REVERSED: dict[int, np.ndarray] = {}


def _reversed(bits: int) -> np.ndarray:
    """Every number of so many bits with its bits in reverse order."""
    if bits not in _REVERSED:
        r, n = np.zeros(1 << bits, np.int64), np.arange(1 << bits)
        for k in range(bits):
            r |= (n >> k & 1) << (bits - 1 - k)
        _REVERSED[bits] = r
    return _REVERSED[bits]


class PrefixCode:
    """Canonical code as a table from the next `bits` bits to symbol and length."""

    NO_BITS = np.zeros(1, np.int64)

    def __init__(self, lengths: np.ndarray | None, only: int = 0):
        used = np.flatnonzero(lengths) if lengths is not None else [only]
        if len(used) <= 1:
            self.bits, self.symbol, self.length = 0, np.array([used[0] if len(used) else 0]), self.NO_BITS
        else:
            self.bits = bits = int(lengths[used].max())
            order = used[np.argsort(lengths[used], kind="stable")]
            share = 1 << (bits - lengths[order])
            if int(share.sum()) != 1 << bits:
                raise BadImage("a prefix code is not complete")
            turn = _reversed(bits)
            self.symbol = np.repeat(order, share)[turn]
            self.length = np.repeat(lengths[order], share)[turn]
        self.mask = U32((1 << self.bits) - 1)

    def read(self, r: BitReader) -> int:
        k = r.view[r.at] & int(self.mask)
        r.at += int(self.length[k])
        return int(self.symbol[k])


def code_lengths(freq: np.ndarray, limit: int) -> np.ndarray:
    """Huffman code lengths of at most `limit` bits; rare symbols count more until the limit holds."""
    out = np.zeros(len(freq), np.int64)
    used = np.flatnonzero(freq)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    used = used[np.argsort(freq[used], kind="stable")]
    counts, floor = freq[used].tolist(), 1
    while True:
        # leaves in order of weight, then inner nodes in order of making: both queues are sorted
        weight = [max(x, floor) for x in counts] + [0] * (n - 1)
        parent = [0] * (2 * n - 1)
        leaf, inner = 0, n
        for new in range(n, 2 * n - 1):
            for _ in range(2):
                if leaf < n and (inner >= new or weight[leaf] <= weight[inner]):
                    k, leaf = leaf, leaf + 1
                else:
                    k, inner = inner, inner + 1
                parent[k] = new
                weight[new] += weight[k]
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= limit:
            out[used] = depth[:n]
            return out
        floor *= 2


def codes(lengths: np.ndarray) -> np.ndarray:
    """The codes of the lengths, with their bits in stream order."""
    out = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return out
    order = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[order]
    top = int(size.max())
    start = np.cumsum(1 << (top - size)) - (1 << (top - size))
    out[order] = _reversed(top)[start]
    return out


def write_single(w: BitWriter, symbol: int) -> None:
    """A prefix code of one symbol, which then takes no bits."""
    w.put(0b101 | symbol << 3, 11)


def write_code(w: BitWriter, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a prefix code for the frequencies; (codes, bits) of each symbol."""
    used = np.flatnonzero(freq)
    if len(used) == 0 or len(used) <= 2 and used[-1] < 256:
        used = used.tolist() or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(1, 1)
        for s in used:
            w.put(s, 8)
        size = np.zeros(len(freq), np.int64)
        if len(used) == 2:
            size[used] = 1
        return codes(size), size
    if len(used) == 1:
        freq = freq.copy()
        freq[0] += 1
    lengths = code_lengths(freq, MAX_BITS)
    tokens: list[tuple[int, int, int]] = []  # (symbol, extra, bits of it)
    edges = np.flatnonzero(lengths[1:] != lengths[:-1]) + 1
    edges = [0, *edges.tolist(), len(lengths)]
    for a, b, v in zip(edges[:-1], edges[1:], lengths[edges[:-1]].tolist()):
        run = b - a
        while v == 0 and run >= 11:
            n = min(run, 138)
            tokens.append((18, n - 11, 7))
            run -= n
        if v == 0 and run >= 3:
            tokens.append((17, run - 3, 3))
            run = 0
        tokens += [(v, 0, 0)] * run
    count = np.bincount([t[0] for t in tokens], minlength=19)
    if (count > 0).sum() == 1:
        count[0 if count[0] == 0 else 1] += 1
    second = code_lengths(count, 7)
    stored = [int(second[s]) for s in CODE_LENGTH_ORDER]
    n = max(4, max(i for i, x in enumerate(stored) if x) + 1)
    w.put(0, 1)
    w.put(n - 4, 4)
    for x in stored[:n]:
        w.put(x, 3)
    w.put(0, 1)
    own, size = codes(second).tolist(), second.tolist()
    for symbol, extra, bits in tokens:
        w.put(own[symbol] | extra << size[symbol], size[symbol] + bits)
    return codes(lengths), lengths


def read_code(r: BitReader, alphabet: int) -> PrefixCode:
    lengths = np.zeros(max(alphabet, 256), np.int64)
    if r.get(1):
        two = r.get(1)
        first = r.get(1)
        symbol = r.get(8 if first else 1)
        if not two and symbol < alphabet:
            return PrefixCode(None, symbol)
        lengths[[symbol, r.get(8)] if two else symbol] = 1
    else:
        small = np.zeros(19, np.int64)
        for s in CODE_LENGTH_ORDER[: 4 + r.get(4)]:
            small[s] = r.get(3)
        code = PrefixCode(small)
        left = 2 + r.get(2 + 2 * r.get(3)) if r.get(1) else alphabet
        i, previous = 0, 8
        while i < alphabet and left:
            left -= 1
            s = code.read(r)
            if s < 16:
                lengths[i] = s
                i, previous = i + 1, s or previous
                continue
            n = (3 + r.get(2), 3 + r.get(3), 11 + r.get(7))[s - 16] if s == 16 else 3 + r.get(3) if s == 17 else 11 + r.get(7)
            if i + n > alphabet:
                raise BadImage("code lengths run over")
            lengths[i : i + n] = previous if s == 16 else 0
            i += n
    if (np.flatnonzero(lengths) >= alphabet).any():
        raise BadImage("a symbol is outside its alphabet")
    return PrefixCode(lengths[:alphabet])


def _value_of(prefix: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Lengths and distances from prefix symbols and their extra bits."""
    bits = np.maximum(prefix - 2, 0) >> 1
    return np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << bits) + extra) + 1


def _prefix_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix symbol, extra bits' value, their number)."""
    v = value - 1
    top = np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1
    bits = np.where(v < 4, 0, top - 1)
    prefix = np.where(v < 4, v, 2 * top + (v >> np.maximum(top - 1, 0) & 1))
    return prefix, np.where(v < 4, 0, v & ((1 << bits) - 1)), bits


# ---------------------------------------------------------------- decoding


def _extra_bits(prefix: np.ndarray) -> np.ndarray:
    return np.where(prefix < 4, 0, (np.maximum(prefix, 4) - 2) >> 1)


def _copies(r: BitReader, at: np.ndarray, length_prefix: np.ndarray, code: PrefixCode):
    """(end position, length, distance code) of back-references whose extra length bits begin at `at`."""
    cap = len(r.windows) - 1
    w = r.windows
    n = _extra_bits(length_prefix)
    length = _value_of(length_prefix, (w[np.minimum(at, cap)] & ((1 << n) - 1).astype(U32)).astype(np.int64))
    at = at + n
    k = (w[np.minimum(at, cap)] & code.mask).astype(np.int64)
    prefix, at = code.symbol[k], at + code.length[k]
    n = _extra_bits(prefix)
    distance = _value_of(prefix, (w[np.minimum(at, cap)] & ((1 << n) - 1).astype(U32)).astype(np.int64))
    return at + n, length, distance


def _tokens_of_one_group(r: BitReader, group: list[PrefixCode], total: int):
    """(kind, value, distance) per token: colour word, length with distance code, or cache slot.

    The next position of every bit position is looked up, then taken twice more, so that the chain steps over four
    tokens at once."""
    green, red, blue, alpha, dist = group
    colours = [c for c in (red, blue, alpha) if c.bits]
    if not green.bits and (not colours or green.symbol[0] > 255):
        if green.symbol[0] > 255:
            return _tokens_of_groups(r, [group], np.zeros(total, np.int64), total)
        word = int(green.symbol[0]) << 8 | int(red.symbol[0]) << 16 | int(blue.symbol[0]) | int(alpha.symbol[0]) << 24
        return np.zeros(total, np.int64), np.full(total, word, np.int64), np.zeros(total, np.int64)
    base, last = r.at, r.end - r.at + 1
    every, cap = r.windows, len(r.windows) - 1
    k = every[base : r.end + 1] & green.mask
    follow = green.length.take(k) + np.arange(last)
    plain = int(green.symbol.max()) < 256
    symbol = None if plain else green.symbol.take(k)
    if colours:
        on = slice(None) if plain else np.flatnonzero(symbol < 256)
        at = follow[on] + base
        for code in colours:
            at = at + code.length.take(every.take(at, mode="clip") & code.mask)
        follow[on] = at - base
    back, far, size = np.zeros(0, np.int64), None, None
    if not plain:
        back = np.flatnonzero((symbol >= 256) & (symbol < 256 + LENGTH_CODES))
        at, size, far = _copies(r, follow[back] + base, symbol[back] - 256, dist)
        follow[back] = at - base
    np.minimum(follow, last - 1, out=follow)
    follow[last - 1] = last - 1
    twice = follow.take(follow)
    step = memoryview(twice.take(twice))
    out, p, stop = [], 0, last - 1
    while p < stop:
        out.append(p)
        p = step[p]
    one = np.array(out, np.int64)
    two, three = follow[one], twice[one]
    at = np.stack([one, two, three, follow[three]], 1).ravel()
    if plain:
        at = at[:total]
        kind = green.symbol.take(k[at])
        distance = np.zeros(len(at), np.int64)
        count = total if len(at) == total else -1
    else:
        kind = symbol[at]
        copied = np.flatnonzero((kind >= 256) & (kind < 256 + LENGTH_CODES))
        place = np.searchsorted(back, at[copied])
        count = np.ones(len(at), np.int64)
        count[copied] = size[place]
        distance = np.zeros(len(at), np.int64)
        distance[copied] = far[place]
        sums = np.cumsum(count)
        n = int(np.searchsorted(sums, total)) + 1
        at, kind, distance, sizes = at[:n], kind[:n], distance[:n], count[:n]
        count = int(sums[n - 1]) if n <= len(sums) else -1
    if count != total or not len(at) or at[-1] >= stop or int(follow[at[-1]]) + base > r.end:
        raise BadImage("the image ends early, or a back-reference runs over it")
    r.at = base + int(follow[at[-1]])
    if not colours:
        value = kind << 8 | (int(red.symbol[0]) << 16 | int(blue.symbol[0]) | int(alpha.symbol[0]) << 24)
    else:
        q = at + green.length.take(k[at]) + base
        value = kind << 8
        for code, shift in ((red, 16), (blue, 0), (alpha, 24)):
            x = every.take(q, mode="clip") & code.mask
            value |= code.symbol.take(x) << shift
            q = q + code.length.take(x)
    if plain:
        return np.zeros(len(at), np.int64), value, distance
    is_copy, is_slot = (kind >= 256) & (kind < 256 + LENGTH_CODES), kind >= 256 + LENGTH_CODES
    value = np.where(is_copy, sizes, np.where(is_slot, kind - 256 - LENGTH_CODES, value))
    return np.where(is_slot, 2, is_copy.astype(np.int64)), value, distance


def _tokens_of_groups(r: BitReader, groups: list[list[PrefixCode]], which: np.ndarray, total: int):
    """The same where the prefix codes change from tile to tile; which: group of each pixel."""
    kinds, values, distances, px = [], [], [], 0
    of = memoryview(np.ascontiguousarray(which))
    while px < total:
        green, red, blue, alpha, dist = groups[of[px]]
        s = green.read(r)
        if s < 256:
            word = s << 8 | red.read(r) << 16
            word |= blue.read(r)
            word |= alpha.read(r) << 24
            kinds.append(0), values.append(word), distances.append(0)
            px += 1
        elif s < 256 + LENGTH_CODES:
            at, length, far = _copies(r, np.array([r.at]), np.array([s - 256]), dist)
            r.at = int(at[0])
            kinds.append(1), values.append(int(length[0])), distances.append(int(far[0]))
            px += values[-1]
        else:
            kinds.append(2), values.append(s - 256 - LENGTH_CODES), distances.append(0)
            px += 1
        if r.at > r.end:
            raise BadImage("the image ends early")
    return np.array(kinds), np.array(values, np.int64), np.array(distances, np.int64)


def _replay(kind: np.ndarray, value: np.ndarray, distance: np.ndarray, width: int, total: int, cache_bits: int) -> np.ndarray:
    """Pixels from tokens: literals at once, back-references in order, the colour cache where there is one."""
    if not cache_bits and not kind.any() and len(kind) == total:
        return value.astype(U32)
    size = np.where(kind == 1, value, 1)
    start = np.cumsum(size) - size
    if int(size.sum()) != total:
        raise BadImage("a back-reference runs over the image")
    out = np.zeros(total, U32)
    lit = kind == 0
    out[start[lit]] = value[lit].astype(U32)
    back = np.flatnonzero(kind == 1)
    far = distance[back]
    near = np.array([x + y * width for x, y in NEAR], np.int64)
    step = np.where(far > len(NEAR), far - len(NEAR), np.maximum(near[np.minimum(far, len(NEAR)) - 1], 1))
    if (step > start[back]).any():
        raise BadImage("a back-reference leaves the image")

    def copy(s: int, n: int, d: int) -> None:
        if d >= n:
            out[s : s + n] = out[s - d : s - d + n]
        else:
            out[s : s + n] = np.resize(out[s - d : s], n)

    if not cache_bits:
        for s, n, d in zip(start[back].tolist(), size[back].tolist(), step.tolist()):
            copy(s, n, d)
        return out
    cache = [0] * (1 << cache_bits)
    shift, steps = 32 - cache_bits, iter(step.tolist())
    for k, v, s, n in zip(kind.tolist(), value.tolist(), start.tolist(), size.tolist()):
        if k == 2:
            out[s] = cache[v]
            continue
        if k == 1:
            copy(s, n, next(steps))
        for word in out[s : s + n].tolist():
            cache[(word * CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift] = word
    return out


def _read_pixels(r: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = 0
    if r.get(1):
        cache_bits = r.get(4)
        if not 1 <= cache_bits <= 11:
            raise BadImage("bad colour cache size")
    which = None
    if main and r.get(1):
        tile = r.get(3) + 2
        side = (1 << tile) - 1
        cols, rows = (width + side) >> tile, (height + side) >> tile
        meta = _read_pixels(r, cols, rows, False)
        which = (meta >> U32(8) & U32(0xFFFF)).astype(np.int64)
        which = which[np.arange(height)[:, None] >> tile, np.arange(width) >> tile].ravel()
    groups = []
    for _ in range(1 if which is None else int(which.max()) + 1):
        sizes = [256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES]
        groups.append([read_code(r, n) for n in sizes])
    total = width * height
    tokens = _tokens_of_one_group(r, groups[0], total) if len(groups) == 1 else _tokens_of_groups(r, groups, which, total)
    return _replay(*tokens, width, total, cache_bits).reshape(height, width)


def _channels(pixels: np.ndarray) -> np.ndarray:
    """height x width x 4 bytes, in the order blue, green, red, alpha."""
    return np.ascontiguousarray(pixels).view(np.uint8).reshape(*pixels.shape, 4)


def _half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def predict(mode: int, left, top, top_left, top_right):
    """The predicted channels (int) of pixels; all arguments have channels last."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return _half(_half(left, top_right), top)
    if mode == 6:
        return _half(left, top_left)
    if mode == 7:
        return _half(left, top)
    if mode == 8:
        return _half(top_left, top)
    if mode == 9:
        return _half(top, top_right)
    if mode == 10:
        return _half(_half(left, top_left), _half(top, top_right))
    if mode == 11:
        to_left, to_top = np.abs(top - top_left).sum(-1, keepdims=True), np.abs(left - top_left).sum(-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = _half(left, top)
        return np.clip(mean + np.trunc((mean - top_left) / 2).astype(np.int64), 0, 255)
    return np.broadcast_to(np.array([0, 0, 0, 255]), left.shape)


def _spans_of(modes: np.ndarray, tile: int, width: int):
    """(mode, first column, end column) along a row; column 0 has no mode."""
    cut = np.flatnonzero(np.diff(modes, prepend=-1))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(modes)]):
        yield int(modes[a]), max(1, a << tile), min(width, b << tile)


def _undo_predictor(pixels: np.ndarray, tiles: np.ndarray, tile: int) -> np.ndarray:
    height, width = pixels.shape
    rest = _channels(pixels).astype(np.int64)
    out = np.zeros_like(rest)
    rest[0, 0, 3] += 255
    out[0] = np.cumsum(rest[0], axis=0) & 255
    modes = (tiles >> U32(8) & U32(15)).astype(np.int64)
    for y in range(1, height):
        up, row = out[y - 1], out[y]
        row[0] = (rest[y, 0] + up[0]) & 255
        right = np.concatenate([up[1:], row[:1]])
        for mode, a, b in _spans_of(modes[y >> tile], tile, width):
            if a >= b:
                continue
            if mode == 1:
                row[a:b] = (row[a - 1] + np.cumsum(rest[y, a:b], axis=0)) & 255
            elif mode in (5, 6, 7, 10, 11, 12, 13):  # they look at the pixel before
                for x in range(a, b):
                    row[x] = (rest[y, x] + predict(mode, row[x - 1], up[x], up[x - 1], right[x])) & 255
            else:
                row[a:b] = (rest[y, a:b] + predict(mode, row[a:b], up[a:b], up[a - 1 : b - 1], right[a:b])) & 255
    return out.astype(np.uint8).view(U32).reshape(height, width)


def _spread_tiles(tiles: np.ndarray, tile: int, height: int, width: int) -> np.ndarray:
    return tiles[np.arange(height)[:, None] >> tile, np.arange(width) >> tile]


def _cross(pixels: np.ndarray, tiles: np.ndarray, tile: int, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes away (-1) what green foretells of red, and green and red of blue."""
    height, width = pixels.shape
    t = _channels(_spread_tiles(tiles, tile, height, width)).view(np.int8).astype(np.int64)
    c = _channels(pixels).copy()
    green = c[..., 1].view(np.int8).astype(np.int64)
    red = c[..., 2].astype(np.int64)
    fresh = red + sign * (t[..., 0] * green >> 5) & 255
    known = (fresh if sign > 0 else red).astype(np.uint8).view(np.int8).astype(np.int64)
    c[..., 2] = fresh
    c[..., 0] = c[..., 0].astype(np.int64) + sign * ((t[..., 1] * green >> 5) + (t[..., 2] * known >> 5)) & 255
    return c.view(U32).reshape(height, width)


def _green_shift(pixels: np.ndarray, sign: int) -> np.ndarray:
    """Adds green to red and blue (sign 1) or takes it away (-1), both at once in one word."""
    two, step = U32(0x00FF00FF), (pixels >> U32(8) & U32(255)) * U32(0x00010001)
    rest = pixels & two
    rest = rest + step if sign > 0 else rest + U32(0x01000100) - step
    return pixels & U32(0xFF00FF00) | rest & two


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _decode_stream(data: bytes) -> np.ndarray:
    r = BitReader(data)
    if r.get(8) != 0x2F:
        raise BadImage("no lossless signature")
    width, height = r.get(14) + 1, r.get(14) + 1
    r.get(1)
    if r.get(3):
        raise BadImage("unknown version")
    undo, seen, wide = [], set(), width
    while r.get(1):
        kind = r.get(2)
        if kind in seen:
            raise BadImage("a transform stands twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = r.get(3) + 2
            side = (1 << tile) - 1
            undo.append((kind, tile, _read_pixels(r, (wide + side) >> tile, (height + side) >> tile, False), wide))
        elif kind == PALETTE:
            n = r.get(8) + 1
            steps = _channels(_read_pixels(r, n, 1, False))
            table = np.cumsum(steps, axis=1, dtype=np.uint8).view(U32).ravel()
            undo.append((kind, _bundle_bits(n), table, wide))
            side = (1 << _bundle_bits(n)) - 1
            wide = (wide + side) >> _bundle_bits(n)
        else:
            undo.append((kind, 0, None, wide))
    pixels = _read_pixels(r, wide, height, True)
    for kind, bits, what, at in reversed(undo):
        if kind == PREDICTOR:
            pixels = _undo_predictor(pixels, what, bits)
        elif kind == CROSS_COLOUR:
            pixels = _cross(pixels, what, bits, 1)
        elif kind == SUBTRACT_GREEN:
            pixels = _green_shift(pixels, 1)
        else:
            each, x = 8 >> bits, np.arange(at)
            index = (pixels[:, x >> bits] >> U32(8) & U32(255)) >> ((x & ((1 << bits) - 1)) * each).astype(U32) & U32((1 << each) - 1)
            whole = np.zeros(256, U32)  # an index beyond the table is transparent black
            whole[: len(what)] = what
            pixels = whole[index]
    return pixels


def decode(data: bytes) -> np.ndarray:
    """Height x width ARGB words of a lossless WebP file; BadImage where it is none."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise BadImage("no WebP container")
    at = 12
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"VP8L":
            if at + 8 + size > len(data):
                raise BadImage("the image ends early")
            return _decode_stream(data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise BadImage("no lossless image in the file")


def split_files(data: bytes) -> list[bytes]:
    """The WebP files that stand one after the other."""
    out, at = [], 0
    while at < len(data):
        if len(data) < at + 12 or data[at : at + 4] != b"RIFF":
            raise BadImage("no WebP container")
        size = 8 + struct.unpack_from("<I", data, at + 4)[0]
        out.append(data[at : at + size])
        at += size + (size & 1)
    return out


# ---------------------------------------------------------------- encoding

#: A back-reference is this many pixels at least; at most, as the format has it.
MIN_COPY, MAX_COPY, WINDOW = 6, 4096, (1 << 20) - 120


def _matches(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pixel (length, distance) of the match with the last place whose next MIN_COPY pixels are the same."""
    n = len(flat)
    length, dist = np.zeros(n, np.int64), np.ones(n, np.int64)
    m = n - MIN_COPY + 1
    if m < 2:
        return length, dist
    word = flat.astype(U64)
    key = np.zeros(m, U64)
    for j in range(MIN_COPY):
        key = (key ^ word[j : j + m]) * U64(0x9E3779B97F4A7C15)
        key ^= key >> U64(29)
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    here, before = order[same + 1], order[same]
    d = here - before
    near = d <= WINDOW
    here, d = here[near], d[near]
    # equal words ahead of each match: where flat differs from itself d pixels before, found by steps
    run = np.zeros(len(here), np.int64)
    live = np.arange(len(here))
    while len(live):
        i = here[live] + run[live]
        ok = i < n
        ok[ok] = flat[i[ok]] == flat[i[ok] - d[live[ok]]]
        live = live[ok]
        run[live] += 1
        live = live[run[live] < MAX_COPY]
        if len(live) and run[live[0]] == 2 * MIN_COPY:  # long ones: by inheritance from the pixel after
            break
    if len(live):
        # a match that goes on has, one pixel later, a match of the same distance; lengths count down along it
        rest = live
        for d0 in np.unique(d[rest]).tolist():
            own = rest[d[rest] == d0]
            differs = np.flatnonzero(flat[d0:] != flat[:-d0]) + d0 if d0 < n else np.zeros(0, np.int64)
            stop = np.searchsorted(differs, here[own])
            ends = np.append(differs, n)[stop]
            run[own] = np.minimum(ends - here[own], MAX_COPY)
    good = run >= MIN_COPY
    length[here[good]], dist[here[good]] = run[good], d[good]
    return length, dist


def _runs(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches with the pixel just before only: runs of one colour."""
    length = np.zeros(len(flat), np.int64)
    edge = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1], [True]]))
    long = np.flatnonzero(np.diff(edge) > MIN_COPY)
    for a, b in zip((edge[long] + 1).tolist(), edge[long + 1].tolist()):
        for at in range(a, b, MAX_COPY):
            n = min(MAX_COPY, b - at)
            length[at] = n if n >= MIN_COPY else 0
    return length, np.ones(len(flat), np.int64)


def _write_pixels(w: BitWriter, pixels: np.ndarray, main: bool, cache_bits: int = 0, copies: str = "runs", split: int = 0) -> None:
    """copies: "runs" of one colour, "all" repeats, or "none". split: tile bits; where given, two groups of prefix
    codes take turns by tiles (main image only)."""
    height, width = pixels.shape
    flat = np.ascontiguousarray(pixels).ravel()
    n = len(flat)
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    which = None
    if main:
        w.put(1 if split else 0, 1)
        if split:
            w.put(split - 2, 3)
            side = (1 << split) - 1
            cols, rows = (width + side) >> split, (height + side) >> split
            tiles = (np.arange(rows)[:, None] + np.arange(cols)) % 2
            _write_pixels(w, (tiles << 8).astype(U32), False)
            which = _spread_tiles(tiles, split, height, width).ravel()
    at, back, length, dist = np.arange(n), np.zeros(0, np.int64), None, None
    if copies != "none":
        length, dist = _matches(flat) if copies == "all" else _runs(flat)
        if length.any():
            starts = np.flatnonzero(length)
            taken, p = [], 0  # greedily, from left to right
            for s, k in zip(starts.tolist(), length[starts].tolist()):
                if s >= p:
                    taken.append(s)
                    p = s + k
            taken = np.array(taken, np.int64)
            inside = np.zeros(n + 1, np.int64)
            inside[taken + 1] += 1
            np.add.at(inside, taken + length[taken], -1)
            at = np.flatnonzero(np.cumsum(inside)[:n] == 0)
            back = np.searchsorted(at, taken)
    colour = flat[at]
    lit = np.ones(len(at), bool)
    lit[back] = False
    green = (colour >> U32(8) & U32(255)).astype(np.int64)
    if cache_bits:
        slot = (flat.astype(U64) * U64(CACHE_MULTIPLIER) & U64(0xFFFFFFFF)) >> U64(32 - cache_bits)
        order = np.argsort(slot, kind="stable")
        known = np.zeros(n, bool)
        known[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (flat[order[1:]] == flat[order[:-1]])
        hit = np.flatnonzero(known[at] & lit)
        green[hit] = 256 + LENGTH_CODES + slot[at[hit]].astype(np.int64)
        lit[hit] = False
    if len(back):
        lp, lx, lb = _prefix_of(length[at[back]])
        green[back] = 256 + lp
        d = dist[at[back]]
        codes_of: dict[int, int] = {}
        for k in range(len(NEAR), 0, -1):
            codes_of[max(1, NEAR[k - 1][0] + NEAR[k - 1][1] * width)] = k
        dp, dx, db = _prefix_of(np.array([codes_of.get(x, x + len(NEAR)) for x in d.tolist()], np.int64))
    varies = int(np.bitwise_or.reduce(colour ^ colour[0])) if len(colour) else 0
    group = None if which is None else which[at]
    value, size = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    greens = 256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0)
    for g in range(1 if group is None else int(which.max()) + 1):
        on = np.arange(len(at)) if group is None else np.flatnonzero(group == g)
        code, bits = write_code(w, np.bincount(green[on], minlength=greens))
        value[on], size[on] = code[green[on]], bits[green[on]]
        on = on if lit.all() else on[lit[on]]
        for shift in (16, 0, 24):
            if varies >> shift & 255:
                c = (colour[on] >> U32(shift) & U32(255)).astype(np.int64)
                code, bits = write_code(w, np.bincount(c, minlength=256))
                value[on] |= code[c] << size[on]
                size[on] += bits[c]
            else:
                write_single(w, int(colour[0]) >> shift & 255)
        if not len(back):
            write_single(w, 0)
        else:
            mine = np.arange(len(back)) if group is None else np.flatnonzero(group[back] == g)
            code, bits = write_code(w, np.bincount(dp[mine], minlength=DISTANCE_CODES))
            b = back[mine]
            for v, k in ((lx, lb), (code[dp], bits[dp]), (dx, db)):
                value[b] |= v[mine] << size[b]
                size[b] += k[mine]
    w.many(value, size)


def _best_modes(pixels: np.ndarray, tile: int) -> np.ndarray:
    """Predictor of each tile: the one with the least sum of residuals."""
    height, width = pixels.shape
    cost = []
    for mode in range(14):
        left = _residuals(pixels, np.full((1, 1), mode), 30)
        size = np.abs(_channels(left).view(np.int8).astype(np.int64)).sum(-1)
        padded = np.zeros((-(-height // (1 << tile)) << tile, -(-width // (1 << tile)) << tile), np.int64)
        padded[:height, :width] = size
        cost.append(padded.reshape(padded.shape[0] >> tile, 1 << tile, padded.shape[1] >> tile, 1 << tile).sum((1, 3)))
    return np.argmin(np.array(cost), axis=0)


def _residuals(pixels: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    height, width = pixels.shape
    c = _channels(pixels).astype(np.int64)
    flat = c.reshape(-1, 4)
    n = len(flat)
    i = np.arange(n)
    left, top = flat[np.maximum(i - 1, 0)], flat[np.maximum(i - width, 0)]
    corner, right = flat[np.maximum(i - width - 1, 0)], flat[np.maximum(i - width + 1, 0)]
    mode = modes[np.arange(height)[:, None] >> tile, np.arange(width) >> tile].ravel().copy()
    mode[::width] = 2
    mode[:width] = 1
    mode[0] = 0
    out = np.zeros_like(flat)
    for m in np.unique(mode).tolist():
        on = mode == m
        out[on] = predict(m, left[on], top[on], corner[on], right[on])
    return ((flat - out) & 255).astype(np.uint8).view(U32).reshape(height, width)


def encode(pixels: np.ndarray, transforms: list[int] | None = None, cache_bits: int = 0, copies: str = "runs", tile: int = 4, split: int = 0) -> bytes:
    """A lossless WebP file of height x width ARGB words.

    transforms: which to apply, in order. By default a palette where there are at most 16 colours, and green taken
    away from red and blue in grey images. copies: see _write_pixels."""
    height, width = pixels.shape
    if not (0 < height <= MAX_SIDE and 0 < width <= MAX_SIDE):
        raise ValueError(f"sides must be 1 to {MAX_SIDE}")
    pixels = np.ascontiguousarray(pixels, U32)
    if transforms is None:
        grey = bool(((pixels ^ (pixels & U32(255)) * U32(0x010101)) == pixels.flat[0] & U32(0xFF000000)).all())
        few = len(np.flatnonzero(np.bincount((pixels & U32(255)).ravel()))) <= 16 if grey else len(np.unique(pixels)) <= 16
        transforms = [PALETTE] if few else [SUBTRACT_GREEN] if grey else []
    w = BitWriter()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(int((pixels >> U32(24) != 255).any()), 1)
    w.put(0, 3)
    for kind in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind == PREDICTOR:
            w.put(tile - 2, 3)
            modes = _best_modes(pixels, tile)
            _write_pixels(w, (0xFF000000 | modes << 8).astype(U32), False)
            pixels = _residuals(pixels, modes, tile)
        elif kind == CROSS_COLOUR:
            w.put(tile - 2, 3)
            h, k = pixels.shape
            tiles = _slopes(pixels, tile)
            _write_pixels(w, tiles, False)
            pixels = _cross(pixels, tiles, tile, -1)
        elif kind == SUBTRACT_GREEN:
            pixels = _green_shift(pixels, -1)
        else:
            colours, index = np.unique(pixels, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("more than 256 colours")
            index = index.reshape(pixels.shape)
            w.put(len(colours) - 1, 8)
            c = _channels(colours[None, :])
            _write_pixels(w, np.diff(c, axis=1, prepend=np.zeros((1, 1, 4), np.uint8)).astype(np.uint8).view(U32).reshape(1, -1), False)
            bits = _bundle_bits(len(colours))
            per, h = 1 << bits, pixels.shape[0]
            k = -(-pixels.shape[1] // per)
            wide = np.zeros((h, k * per), np.int64)
            wide[:, : pixels.shape[1]] = index
            packed = (wide.reshape(h, k, per) << np.arange(per) * (8 >> bits)).sum(2)
            pixels = (0xFF000000 | packed << 8).astype(U32)
    w.put(0, 1)
    _write_pixels(w, pixels, True, cache_bits, copies, split)
    body = w.bytes()
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


def _slopes(pixels: np.ndarray, tile: int) -> np.ndarray:
    """Cross-colour multipliers of each tile: least squares of red and blue on green, in 32nds."""
    height, width = pixels.shape
    c = _channels(pixels).view(np.int8).astype(np.float64)
    high, wide = -(-height // (1 << tile)), -(-width // (1 << tile))
    padded = np.zeros((high << tile, wide << tile, 4))
    padded[:height, :width] = c
    t = padded.reshape(high, 1 << tile, wide, 1 << tile, 4)
    square = (t[..., 1] ** 2).sum((1, 3)) + 1e-9
    out = np.zeros((high, wide, 4), np.int8)
    out[..., 0] = np.clip(np.round(32 * (t[..., 2] * t[..., 1]).sum((1, 3)) / square), -127, 127)
    out[..., 1] = np.clip(np.round(32 * (t[..., 0] * t[..., 1]).sum((1, 3)) / square), -127, 127)
    out[..., 3] = -1
    return out.view(U32).reshape(high, wide)
