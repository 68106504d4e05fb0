"""Lossless WebP (VP8L) in numpy: container, encoder, and a decoder for the whole bitstream.

The decoder reads prefix codes, LZ77 back-references, the colour cache and meta prefix groups and
inverts the predictor, cross-colour, subtract-green and palette transforms. Where every prefix code
of a literal-only image has one length, pixels have a fixed stride and are read by array operations;
any other stream goes through the symbol loop.
"""

from __future__ import annotations

import struct

import numpy as np

WIDTH = 48
MAX_SIDE = 16384
#: Fixed by the format: order in which code-length code lengths are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed by the format: the short distances are the pixels around, nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: ASCII 0 and 1 to bytes 0 and 1.
_BITS = bytes.maketrans(b"01", b"\0\1")


# ---------------------------------------------------------------- bits


class Reader:
    """Least-significant-bit-first reader."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
        self.raw = bytes(data)
        self.pos, self.end = 0, 8 * len(data)

    def read(self, n: int) -> int:
        p = self.pos
        self.pos = p + n
        if p + n > self.end:
            raise ValueError("truncated stream")
        return int.from_bytes(self.raw[p >> 3 : (p >> 3) + 4], "little") >> (p & 7) & (1 << n) - 1


class Writer:
    """One byte for each bit until the end."""

    def __init__(self):
        self.bits = bytearray()

    def write(self, value: int, n: int) -> None:
        self.bits += bytes([value >> i & 1 for i in range(n)])

    def array(self, bits: np.ndarray) -> None:
        self.bits += bits.tobytes()

    def bytes(self) -> bytes:
        return np.packbits(np.frombuffer(self.bits, np.uint8), bitorder="little").tobytes()


# ---------------------------------------------------------------- prefix codes


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, codes) of the canonical code, shortest codes first."""
    used = lengths.nonzero()[0]
    ks = lengths[used].astype(np.int64)
    if len(used) and ks.min() == ks.max():
        return used, np.arange(len(used))
    order = np.argsort(ks, kind="stable")
    left = (ks[order].max() if len(used) else 0) - ks[order]
    room = 1 << left
    return used[order], np.cumsum(room) - room >> left


#: The low 15 bits of each index, first bit last.
REVERSED = np.packbits(np.unpackbits(np.arange(1 << 15, dtype=">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, ::-1], axis=1).view(">u2").ravel().astype(np.int64) >> 1
REVERSED = REVERSED.tolist()


class Code:
    """One prefix code. ``table`` maps the next ``depth`` bits (first bit highest) to (symbol, length)."""

    def __init__(self, lengths: np.ndarray | None = None, only: int | None = None):
        self.only, self.depth, self.stride = only, 0, None
        if lengths is not None:
            used = np.flatnonzero(lengths)
            if not len(used):
                self.only = 0
            elif len(used) == 1:
                self.only = int(used[0])
            else:
                self.build(lengths)
        if self.only is not None:
            self.stride, self.symbols = 0, np.array([self.only])

    def build(self, lengths: np.ndarray) -> None:
        order, _ = canonical(lengths)
        ks = lengths[order].astype(np.int64)
        self.depth = int(ks[-1])
        if int((1 << (self.depth - ks)).sum()) != 1 << self.depth:
            raise ValueError("incomplete prefix code")
        self.sym = np.repeat(order, 1 << (self.depth - ks))
        self.len = np.repeat(ks, 1 << (self.depth - ks))
        if ks[0] == ks[-1]:
            self.stride, self.symbols = int(ks[0]), order
        self.sym_list, self.len_list = None, None

    def next(self, r: Reader) -> int:
        if self.only is not None:
            return self.only
        if self.sym_list is None:
            self.sym_list, self.len_list = self.sym.tolist(), self.len.tolist()
        p = r.pos
        v = int.from_bytes(r.raw[p >> 3 : (p >> 3) + 4], "little") >> (p & 7) & (1 << self.depth) - 1
        v = REVERSED[v] >> (15 - self.depth)
        r.pos = p + self.len_list[v]
        if r.pos > r.end:
            raise ValueError("truncated stream")
        return self.sym_list[v]


def read_code(r: Reader, size: int) -> Code:
    if r.read(1):  # simple
        two, wide = r.read(1), r.read(1)
        first = r.read(8 if wide else 1)
        if not two:
            return Code(only=first)
        lengths = np.zeros(max(size, 256), np.uint8)
        second = r.read(8)
        if second == first:
            return Code(only=first)
        lengths[[first, second]] = 1
        return Code(lengths)
    of_lengths = np.zeros(19, np.uint8)
    for s in LENGTH_ORDER[: 4 + r.read(4)]:
        of_lengths[s] = r.read(3)
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else size
    if left > size:
        raise ValueError("too many code lengths")
    code = Code(of_lengths)
    lengths = np.zeros(size, np.uint8)
    if code.stride == 1 and code.symbols[-1] < 16:  # two plain lengths: one bit each
        take = r.bits[r.pos : r.pos + left]
        r.pos += left
        lengths[:left] = code.symbols[take]
        return Code(lengths)
    i, before = 0, 8
    while i < size and left:
        left -= 1
        s = code.next(r)
        if s < 16:
            lengths[i] = s
            before = s or before
            i += 1
            continue
        n = 3 + r.read(2) if s == 16 else 3 + r.read(3) if s == 17 else 11 + r.read(7)
        if i + n > size:
            raise ValueError("code lengths overrun")
        lengths[i : i + n] = before if s == 16 else 0
        i += n
    return Code(lengths)


def lengths_of(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Huffman code lengths for the counts, none above ``limit``."""
    import heapq

    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    floor = 1
    while True:
        heap = [(max(int(counts[s]), floor), int(s), None) for s in used]
        heapq.heapify(heap)
        fresh = len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], fresh, (a, b)))
            fresh += 1
        stack, deepest = [(heap[0], 0)], 0
        while stack:
            (_, s, kids), d = stack.pop()
            if kids:
                stack += [(kids[0], d + 1), (kids[1], d + 1)]
            else:
                out[s] = d
                deepest = max(deepest, d)
        if deepest <= limit:
            return out
        floor = floor * 2


def flat_lengths(used: np.ndarray, size: int) -> np.ndarray:
    """One length for all: the used symbols, filled up with unused ones to a power of two."""
    out = np.zeros(size, np.uint8)
    n = len(used)
    if n == 1:
        out[used] = 1
        return out
    k = int(n - 1).bit_length()
    mark = np.zeros(size, bool)
    mark[used] = True
    fill = np.flatnonzero(~mark)[: (1 << k) - n]
    out[used], out[fill] = k, k
    return out


def write_code(w: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        s = int(used[0]) if len(used) else 0
        w.write(1 | 0 << 1 | 1 << 2, 3)
        w.write(s, 8)
        return
    if len(used) == 2 and used[1] < 256:
        w.write(1 | 1 << 1 | 1 << 2, 3)
        w.write(int(used[0]), 8)
        w.write(int(used[1]), 8)
        return
    top = int(used[-1]) + 1
    kinds = np.unique(lengths[:top])
    if len(kinds) == 1:
        kinds = np.unique([0, kinds[0]])
    of = np.zeros(19, np.uint8)
    k = int(len(kinds) - 1).bit_length()
    spare = [x for x in range(16) if x not in kinds][: (1 << k) - len(kinds)] if len(kinds) != 1 << k else []
    of[kinds], of[spare] = k, k
    w.write(0, 1)
    count = max(4, 1 + max(i for i, s in enumerate(LENGTH_ORDER) if of[s]))
    w.write(count - 4, 4)
    for s in LENGTH_ORDER[:count]:
        w.write(int(of[s]), 3)
    top = max(top, 2)
    w.write(1, 1)
    if top - 2 < 1024:
        w.write(4, 3)  # ten bits follow
        w.write(top - 2, 10)
    else:
        w.write(7, 3)
        w.write(top - 2, 16)
    order, codes = canonical(of)
    rank = np.zeros(19, np.int64)
    rank[order] = codes
    v = rank[lengths[:top]]
    w.array((v[:, None] >> np.arange(k - 1, -1, -1) & 1).astype(np.uint8).ravel())


# ---------------------------------------------------------------- decoding


def prefix_value(r: Reader, s: int) -> int:
    if s < 4:
        return s + 1
    extra = (s - 2) >> 1
    return ((2 + (s & 1)) << extra) + r.read(extra) + 1


def decode_image(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as uint32 ARGB of width * height pixels."""
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise ValueError("bad colour cache")
    groups, meta, meta_bits = 1, None, 0
    if main and r.read(1):
        meta_bits = r.read(3) + 2
        mw, mh = -(-width >> meta_bits), -(-height >> meta_bits)
        meta = (decode_image(r, mw, mh, False) >> np.uint32(8) & np.uint32(0xFFFF)).reshape(mh, mw)
        groups = int(meta.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[read_code(r, n) for n in (280 + cache_size, 256, 256, 256, 40)] for _ in range(groups)]
    total = width * height
    if groups == 1 and all(c.stride is not None for c in codes[0][:4]) and (codes[0][0].symbols < 256).all():
        return fixed_stride(r, codes[0], total)
    out = [0] * total
    cache = [0] * cache_size
    shift = 32 - cache_bits
    at, cached = 0, 0
    group = codes[0]
    while at < total:
        if meta is not None:
            group = codes[int(meta[at // width >> meta_bits, at % width >> meta_bits])]
        s = group[0].next(r)
        if s < 256:
            red = group[1].next(r)
            blue = group[2].next(r)
            out[at] = group[3].next(r) << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            n = prefix_value(r, s - 256)
            d = prefix_value(r, group[4].next(r))
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > at or at + n > total:
                raise ValueError("bad back-reference")
            for _ in range(n):
                out[at] = out[at - d]
                at += 1
        else:
            while cached < at:
                cache[(0x1E35A7BD * out[cached] & 0xFFFFFFFF) >> shift] = out[cached]
                cached += 1
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32)


def fixed_stride(r: Reader, codes: list[Code], total: int) -> np.ndarray:
    strides = [c.stride for c in codes[:4]]
    step = sum(strides)
    if r.pos + total * step > len(r.bits):
        raise ValueError("truncated stream")
    rows = r.bits[r.pos : r.pos + total * step].reshape(total, step)
    r.pos += total * step
    out, at = np.zeros(total, np.uint32), 0
    for code, k, shift in zip(codes, strides, (8, 16, 0, 24), strict=False):
        index = np.zeros(total, np.intp)
        for i in range(k):
            index = index << 1 | rows[:, at + i]
        out |= code.symbols.astype(np.uint32)[index] << np.uint32(shift)
        at += k
    return out


def add_argb(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _join(c) -> int:
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def _select(left: int, top: int, corner: int) -> int:
    p = [x + y - z for x, y, z in zip(_channels(left), _channels(top), _channels(corner), strict=True)]
    to_left = sum(abs(x - y) for x, y in zip(p, _channels(left), strict=True))
    to_top = sum(abs(x - y) for x, y in zip(p, _channels(top), strict=True))
    return left if to_left < to_top else top


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def predict(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The value that predictor ``mode`` gives from the left, top, top-right and top-left pixels."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _average(_average(left, right), top)
    if mode == 6:
        return _average(left, corner)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(corner, top)
    if mode == 9:
        return _average(top, right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return _join([_clamp(x + y - z) for x, y, z in zip(_channels(left), _channels(top), _channels(corner), strict=True)])
    if mode == 13:
        mean = _channels(_average(left, top))
        return _join([_clamp(m + int((m - z) / 2)) for m, z in zip(mean, _channels(corner), strict=True)])
    return 0xFF000000


def predictions(px: list[int], width: int, at: int, mode: int) -> int:
    """The prediction for pixel ``at`` of the pixels before it."""
    y, x = divmod(at, width)
    if not at:
        return 0xFF000000
    if not y:
        return px[at - 1]
    if not x:
        return px[at - width]
    return predict(mode, px[at - 1], px[at - width], px[at - width + 1], px[at - width - 1])


def undo_predictor(px: np.ndarray, width: int, bits: int, modes: np.ndarray) -> np.ndarray:
    height = len(px) // width
    per_row = -(-width >> bits)
    kinds = (modes >> np.uint32(8) & np.uint32(15)).reshape(-1, per_row)
    if (kinds == 2).all():  # only the row above: a running sum down each column
        c = px.reshape(height, width).view(np.uint8).reshape(height, width, 4).copy()
        first = c[0].copy()
        first[0, 3] += 255
        c[0] = np.cumsum(first, axis=0, dtype=np.uint8)
        return np.cumsum(c, axis=0, dtype=np.uint8).reshape(-1).view(np.uint32)
    out = px.tolist()
    table = kinds.tolist()
    for at in range(len(out)):
        y, x = divmod(at, width)
        out[at] = add_argb(out[at], predictions(out, width, at, table[y >> bits][x >> bits]))
    return np.array(out, np.uint32)


def cross_colour(px: np.ndarray, width: int, bits: int, factors: np.ndarray, undo: bool = True) -> np.ndarray:
    """Add (or take away) the green and red shares from red and blue."""
    height = len(px) // width
    per_row = -(-width >> bits)
    f = factors.reshape(-1, per_row)[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits].ravel()
    s8 = lambda v: (v & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    g2r, g2b, r2b = s8(f), s8(f >> np.uint32(8)), s8(f >> np.uint32(16))
    green, red, blue = s8(px >> np.uint32(8)), (px >> np.uint32(16) & np.uint32(255)).astype(np.int32), (px & np.uint32(255)).astype(np.int32)
    sign = 1 if undo else -1
    new_red = red + sign * (g2r * green >> 5) & 255
    for_blue = s8(new_red if undo else red)
    new_blue = blue + sign * ((g2b * green >> 5) + (r2b * for_blue >> 5)) & 255
    return px & np.uint32(0xFF00FF00) | new_red.astype(np.uint32) << np.uint32(16) | new_blue.astype(np.uint32)


def green_shift(px: np.ndarray, sign: int) -> np.ndarray:
    c = px.view(np.uint8).reshape(-1, 4).copy()
    for i in (0, 2):
        c[:, i] = c[:, i] + c[:, 1] if sign > 0 else c[:, i] - c[:, 1]
    return c.reshape(-1).view(np.uint32)


def running_add(px: np.ndarray) -> np.ndarray:
    return np.cumsum(px.view(np.uint8).reshape(-1, 4), axis=0, dtype=np.uint8).reshape(-1).view(np.uint32)


def palette_bits(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def undo_palette(px: np.ndarray, width: int, table: np.ndarray) -> np.ndarray:
    bits = palette_bits(len(table))
    packed = -(-width >> bits)
    green = (px >> np.uint32(8) & np.uint32(255)).reshape(-1, packed)
    per, each = 1 << bits, 8 >> bits
    index = (green[:, :, None] >> (np.arange(per, dtype=np.uint32) * np.uint32(each))) & np.uint32((1 << each) - 1)
    index = index.reshape(len(green), -1)[:, :width].ravel()
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index]


def decode(data: bytes) -> np.ndarray:
    """A .webp file holding one VP8L image -> uint8 array (height, width, 4), channels R, G, B, A."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    r = Reader(data[20 : 20 + size])
    if r.read(8) != 0x2F:
        raise ValueError("bad signature")
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    todo, seen, now = [], set(), width
    while r.read(1):
        kind = r.read(2)
        if kind in seen:
            raise ValueError("transform used twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            todo.append((kind, now, bits, decode_image(r, -(-now >> bits), -(-height >> bits), False)))
        elif kind == SUBTRACT_GREEN:
            todo.append((kind, now, 0, None))
        else:
            n = r.read(8) + 1
            todo.append((kind, now, 0, running_add(decode_image(r, n, 1, False))))
            now = -(-now >> palette_bits(n))
    px = decode_image(r, now, height, True)
    for kind, w, bits, extra in reversed(todo):
        if kind == PREDICTOR:
            px = undo_predictor(px, w, bits, extra)
        elif kind == CROSS_COLOUR:
            px = cross_colour(px, w, bits, extra)
        elif kind == SUBTRACT_GREEN:
            px = green_shift(px, 1)
        else:
            px = undo_palette(px, w, extra)
    return px.view(np.uint8).reshape(height, width, 4)[:, :, [2, 1, 0, 3]]


# ---------------------------------------------------------------- encoding


def _emit(w: Writer, streams: list[tuple[np.ndarray, np.ndarray]], extra=None) -> None:
    """Interleave symbols of several codes; streams: (lengths, symbols)."""
    cols = []
    for lengths, symbols in streams:
        order, codes = canonical(lengths)
        if len(order) < 2:
            continue
        k = int(lengths[order[0]])
        bits = np.zeros((len(lengths), k), np.uint8)
        bits[order] = codes[:, None] >> np.arange(k - 1, -1, -1) & 1
        cols.append(bits[symbols])
    if cols:
        w.array(np.concatenate(cols, axis=1).ravel())


def encode_image(w: Writer, px: np.ndarray, main: bool) -> None:
    """Literals under flat prefix codes: one length for each channel, so a pixel has a fixed stride."""
    w.write(0, 1)  # no colour cache
    if main:
        w.write(0, 1)  # one group
    streams = []
    for shift, size in ((8, 280), (16, 256), (0, 256), (24, 256)):
        v = (px >> np.uint32(shift) & np.uint32(255)).astype(np.intp)
        lengths = flat_lengths(np.flatnonzero(np.bincount(v, minlength=256)), size)
        streams.append((lengths, v))
        write_code(w, lengths)
    write_code(w, np.zeros(40, np.uint8))
    _emit(w, streams)


def _prefix_symbol(v: int) -> tuple[int, int, int]:
    """(symbol, extra bits, their value) of a length or distance."""
    if v <= 4:
        return v - 1, 0, 0
    v -= 1
    top = v.bit_length() - 1
    half = v >> (top - 1) & 1
    return 2 * top + half, top - 1, v & (1 << (top - 1)) - 1


def tokens_of(px: np.ndarray, cache_bits: int) -> list[tuple]:
    """Greedy LZ77 over pixels with a colour cache: literals, cached colours and (length, distance)."""
    p, n, i = px.tolist(), len(px), 0
    last: dict[tuple, int] = {}
    cache = [0] * (1 << cache_bits) if cache_bits else None
    out = []

    def note(j: int) -> None:
        if j + 3 <= n:
            last[tuple(p[j : j + 3])] = j
        if cache is not None:
            cache[(0x1E35A7BD * p[j] & 0xFFFFFFFF) >> (32 - cache_bits)] = p[j]

    while i < n:
        j = last.get(tuple(p[i : i + 3])) if i + 3 <= n else None
        if j is not None:
            k = 3
            while i + k < n and k < 4096 and p[j + k] == p[i + k]:
                k += 1
            out.append(("copy", k, i - j))
            for q in range(i, i + k):
                note(q)
            i += k
            continue
        slot = (0x1E35A7BD * p[i] & 0xFFFFFFFF) >> (32 - cache_bits) if cache is not None else -1
        out.append(("cached", slot, 0) if cache is not None and cache[slot] == p[i] and i else ("pixel", p[i], 0))
        note(i)
        i += 1
    return out


def encode_tokens(w: Writer, px: np.ndarray, cache_bits: int, main: bool) -> None:
    """Huffman-coded literals, back-references and colour-cache hits."""
    toks = tokens_of(px, cache_bits)
    if cache_bits:
        w.write(1, 1)
        w.write(cache_bits, 4)
    else:
        w.write(0, 1)
    if main:
        w.write(0, 1)
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts, steps = [np.zeros(s, np.int64) for s in sizes], []
    for kind, a, b in toks:
        if kind == "pixel":
            seq = [(0, a >> 8 & 255, 0, 0), (1, a >> 16 & 255, 0, 0), (2, a & 255, 0, 0), (3, a >> 24, 0, 0)]
        elif kind == "cached":
            seq = [(0, 280 + a, 0, 0)]
        else:
            s, k, v = _prefix_symbol(a)
            t, l, u = _prefix_symbol(b + 120)
            seq = [(0, 256 + s, k, v), (4, t, l, u)]
        for c, s, *_ in seq:
            counts[c][s] += 1
        steps += seq
    lengths = [lengths_of(c) for c in counts]
    words = []
    for ls in lengths:
        write_code(w, ls)
        order, codes = canonical(ls)
        words.append({int(s): (int(c), int(ls[s])) for s, c in zip(order, codes, strict=True)} if len(order) > 1 else {int(s): (0, 0) for s in order})
    bits = bytearray()
    text = [{s: f"{c:0{n}b}".encode().translate(_BITS) if n else b"" for s, (c, n) in t.items()} for t in words]
    for c, s, k, v in steps:
        bits += text[c][s]
        if k:
            bits += f"{v:0{k}b}"[::-1].encode().translate(_BITS)
    w.bits += bits


def encode(image: np.ndarray, mode: str = "auto", bits: int = 4, cache_bits: int = 0) -> bytes:
    """(height, width, 4) RGBA bytes -> .webp bytes.

    mode: "flat" literal-only; "palette" (at most 256 colours); "lz" back-references and colour
    cache; "predictor", "cross" and "green" put that transform before the flat image; "auto" takes the
    palette for at most 16 colours, back-references where under a quarter of the pixels differ, else flat.
    """
    height, width = image.shape[:2]
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError("image too large")
    px = np.ascontiguousarray(image[:, :, [2, 1, 0, 3]]).reshape(-1).view(np.uint32)
    if mode == "auto":
        distinct = len(np.unique(px))
        mode = "palette" if distinct <= 16 else "lz" if distinct * 4 < len(px) else "flat"
    w = Writer()
    w.write(0x2F, 8)
    w.write(width - 1, 14)
    w.write(height - 1, 14)
    w.write(1, 1)
    w.write(0, 3)
    if mode == "palette":
        table, index = np.unique(px, return_inverse=True)
        if len(table) > 256:
            raise ValueError("too many colours for a palette")
        w.write(1 | PALETTE << 1, 3)
        w.write(len(table) - 1, 8)
        steps = table.view(np.uint8).reshape(-1, 4).copy()
        steps[1:] -= table.view(np.uint8).reshape(-1, 4)[:-1]
        encode_image(w, steps.reshape(-1).view(np.uint32), False)
        pb = palette_bits(len(table))
        per = 1 << pb
        grid = np.zeros((height, -(-width >> pb) * per), np.uint32)
        grid[:, :width] = index.reshape(height, width)
        packed = (grid.reshape(height, -1, per) << (np.arange(per, dtype=np.uint32) * np.uint32(8 >> pb))).sum(axis=2, dtype=np.uint32)
        px = (packed << np.uint32(8) | np.uint32(0xFF000000)).ravel()
        width = packed.shape[1]
    elif mode == "green":
        w.write(1 | SUBTRACT_GREEN << 1, 3)
        px = green_shift(px, -1)
    elif mode in ("predictor", "cross"):
        w.write(1 | (PREDICTOR if mode == "predictor" else CROSS_COLOUR) << 1, 3)
        w.write(bits - 2, 3)
        bw, bh = -(-width >> bits), -(-height >> bits)
        side = np.arange(bw * bh, dtype=np.uint32)
        if mode == "predictor":
            kinds = side % np.uint32(14)
            encode_image(w, kinds << np.uint32(8) | np.uint32(0xFF000000), False)
            src, grid = px.tolist(), kinds.reshape(bh, bw).tolist()
            minus = lambda a, b: ((a | 0x00FF00FF) - (b & 0xFF00FF00) & 0xFF00FF00) | ((a | 0xFF00FF00) - (b & 0x00FF00FF) & 0x00FF00FF)
            px = np.array([minus(v, predictions(src, width, i, grid[i // width >> bits][i % width >> bits])) for i, v in enumerate(src)], np.uint32)
        else:
            factors = (side * np.uint32(2654435761)) & np.uint32(0xFFFFFF) | np.uint32(0xFF000000)
            encode_image(w, factors, False)
            px = cross_colour(px, width, bits, factors, undo=False)
    w.write(0, 1)
    if mode == "lz":
        encode_tokens(w, px, cache_bits or 6, True)
    else:
        encode_image(w, px, True)
    body = w.bytes()
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


# ---------------------------------------------------------------- payloads


def store(payload: bytes) -> bytes:
    """A payload whose length is a positive multiple of 192 as one or more images of 48 pixels (192 bytes) a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 4)
    return b"".join(encode(rows[i : i + MAX_SIDE]) for i in range(0, len(rows), MAX_SIDE))


def images(media: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        out.append(decode(media[at : at + size]))
        at += size
    return out
