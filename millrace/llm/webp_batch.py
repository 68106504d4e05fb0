"""Many lossless WebP images of one width at once: the payload store of operator 1, in numpy.

Images are coded and decoded in step: every array operation handles one pixel, symbol or code length of all images, so the cost of
a call is shared. Each image goes through

* the palette transform, if it has at most 16 colours (those few are left to ``webp``), else
* the predictor and the cross-colour transform: for each block of 32 x 32 pixels the mode, and the three multipliers, that leave the
  channels with the least entropy (mode 0 and multipliers 0 are among them),
* back-references (the last place of the next three pixels) and a colour cache of 64,
* prefix codes of their own for each image, complete and of at most 15 bits.

The decoder reads any stream of these parts, also with other code lengths, repeats in them, the subtract-green
transform and other block sizes; streams with palettes, meta prefix groups or other widths go to ``webp.decode``.
Images have at most ROWS rows; a longer payload is several images one after another.
"""

from __future__ import annotations

import struct

import numpy as np

from . import webp
from .webp import CROSS_COLOUR, LENGTH_ORDER, NEAR, PALETTE, PREDICTOR, REVERSED, SUBTRACT_GREEN, WIDTH

ROWS = 32
#: Bytes of images that are coded in step, about.
STEP_BYTES = 4 << 20
#: Pixels for which modes are chosen, and tokens written, at once, so that the work arrays stay in a core's cache.
PART_PIXELS, WRITE_PIXELS = 1 << 14, 1 << 17
BITS, CACHE_BITS, COLOURS = 5, 6, 16
GREEN, CODES = 280, (8, 16, 0, 24)
HASH = np.uint32(0x1E35A7BD)
MULTIPLIERS = (0, 8, 16, 32, -16)
_REVERSED = np.array(REVERSED, np.int64)
_COUNT = np.arange(1 << 16, dtype=np.float64)
_COUNT[1:] *= np.log2(_COUNT[1:])
_COUNT = _COUNT.astype(np.float32)
_NEAR = np.array([max(1, x + y * WIDTH) for x, y in NEAR], np.int64)


def average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a & b) + ((a ^ b) >> 1)


def predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The prediction of ``mode`` from neighbouring pixels, as (n, 4) bytes."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return average(average(left, right), top)
    if mode == 6:
        return average(left, corner)
    if mode == 7:
        return average(left, top)
    if mode == 8:
        return average(corner, top)
    if mode == 9:
        return average(top, right)
    if mode == 10:
        return average(average(left, corner), average(top, right))
    if mode in (11, 12):
        a, b, c = left.astype(np.int16), top.astype(np.int16), corner.astype(np.int16)
        if mode == 12:
            return np.clip(a + b - c, 0, 255).astype(np.uint8)
        gap = np.abs(b - c) - np.abs(a - c)
        return np.where((gap[:, 0] + gap[:, 1] + gap[:, 2] + gap[:, 3] < 0)[:, None], left, top)
    if mode == 13:
        mean, c = average(left, top).astype(np.int16), corner.astype(np.int16)
        gap = mean - c
        return np.clip(mean + (gap + (gap < 0)) // 2, 0, 255).astype(np.uint8)
    out = np.zeros_like(left)
    out[:, 3] = 255
    return out


class Layout:
    """Images of WIDTH pixels a row, one after another in arrays of pixels."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.n = rows, len(rows)
        self.size = rows * WIDTH
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.image = np.repeat(np.arange(self.n), self.size)
        self.at = np.arange(int(self.first[-1])) - self.first[self.image]

    def blocks(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(block of each pixel, first block of each image)."""
        across = -(-WIDTH >> bits)
        first = np.concatenate([[0], np.cumsum(across * -(-self.rows >> bits))])
        return first[self.image] + (self.at // WIDTH >> bits) * across + (self.at % WIDTH >> bits), first

    def parts(self, pixels: int):
        """(i, j, their pixels as a slice) of runs of whole images, of at most so many pixels or one image."""
        i = 0
        while i < self.n:
            j = max(i + 1, int(np.searchsorted(self.first, self.first[i] + pixels, "right")) - 1)
            yield i, j, slice(int(self.first[i]), int(self.first[j]))
            i = j


class Steps:
    """Pixels of images of ``size`` in the order they are taken in step: the first of all images, then the second of all.

    by: the images, largest first; live: how many have a pixel t; opens: where the pixels t begin."""

    def __init__(self, size: np.ndarray):
        self.by = np.argsort(-size, kind="stable")
        self.longest = int(size.max(initial=0))
        live = np.searchsorted(-size[self.by], -np.arange(1, self.longest + 1), "right")
        self.opens = np.concatenate([[0], np.cumsum(live)])
        self.live = live.tolist()
        rank = np.empty(len(size), np.int64)
        rank[self.by] = np.arange(len(size))
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        #: Place of each pixel of the images, one image after another, in this order.
        self.place = self.opens[at] + np.repeat(rank, size)

    def turned(self, v: np.ndarray) -> np.ndarray:
        out = np.empty_like(v)
        out[self.place] = v
        return out

    def each(self):
        """(pixel t, number of images that have it, where it begins)."""
        return zip(range(self.longest), self.live, self.opens.tolist(), strict=False)


def _evenness(cell: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    """Sum of count * log2(count) of the byte values in each block (cell: 256 times its number): the larger, the less entropy."""
    return _COUNT[np.bincount(cell + values, minlength=n * 256)].reshape(n, 256).sum(1)


# ---------------------------------------------------------------- transforms of the encoder


def _joined(parts: list[tuple]) -> tuple:
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def choose_predictors(c: np.ndarray, lay: Layout) -> tuple[np.ndarray, np.ndarray]:
    """(residuals as (n, 4) bytes, mode of each block)."""
    return _joined([_predictors(c[px], Layout(lay.rows[i:j])) for i, j, px in lay.parts(PART_PIXELS)])


def _predictors(c: np.ndarray, lay: Layout) -> tuple[np.ndarray, np.ndarray]:
    block, first = lay.blocks(BITS)
    padded = np.concatenate([np.zeros((WIDTH + 1, 4), np.uint8), c])
    n, blocks = len(c), int(first[-1])
    left, top, right, corner = (padded[WIDTH + 1 - d : WIDTH + 1 - d + n] for d in (1, WIDTH, WIDTH - 1, WIDTH + 1))
    edge = np.flatnonzero((lay.at < WIDTH) | (lay.at % WIDTH == 0))
    border = np.where((lay.at[edge] < WIDTH)[:, None], left[edge], top[edge])
    border[lay.at[edge] == 0] = (0, 0, 0, 255)
    border = (c[edge] - border).view(np.uint32).ravel()
    best, modes = np.full(blocks, -1.0), np.zeros(blocks, np.int64)
    cell = (block[:, None] * 4 + np.arange(4)) * 256
    where, found = np.empty_like(cell), np.empty(n, np.uint32)
    for mode in range(14):
        rest = c - predict(mode, left, top, right, corner)
        whole = rest.view(np.uint32).ravel()
        whole[edge] = border
        np.add(cell, rest, out=where)
        even = _COUNT.take(np.bincount(where.ravel(), minlength=blocks * 1024)).reshape(blocks, 4, 256).sum(2)
        score = even[:, 0] + even[:, 1] + even[:, 2] + even[:, 3]
        better = score > best + 1e-3
        best[better], modes[better] = score[better], mode
        np.copyto(found, whole, where=better[block])
    return found.view(np.uint8).reshape(-1, 4), modes


def choose_cross_colour(c: np.ndarray, lay: Layout) -> tuple[np.ndarray, np.ndarray]:
    """(pixels with shares of green and red taken away, multipliers of each block as (n, 3) bytes: green to red, green to blue, red to blue)."""
    return _joined([_cross_colour(c[px], Layout(lay.rows[i:j])) for i, j, px in lay.parts(PART_PIXELS)])


def _cross_colour(c: np.ndarray, lay: Layout) -> tuple[np.ndarray, np.ndarray]:
    block, first = lay.blocks(BITS)
    n, cell = int(first[-1]), block * 256
    red, green, blue = (c[:, k].view(np.int8).astype(np.int16) for k in (0, 1, 2))
    factors = np.zeros((n, 3), np.int8)
    out = c.copy()
    base = blue
    for k, (source, channel) in enumerate(((green, 0), (green, 2), (red, 2))):
        best = np.full(n, -1.0)
        now = red if channel == 0 else base
        taken = np.zeros(len(c), np.uint8)
        for m in MULTIPLIERS:
            rest = (now - (m * source >> 5)).astype(np.uint8)
            score = _evenness(cell, n, rest)
            better = score > best + 1e-3
            best[better], factors[better, k] = score[better], m
            np.copyto(taken, rest, where=better[block])
        out[:, channel] = taken
        if channel == 2:
            base = taken.astype(np.int16)
    return out, factors


def _repeats(px: np.ndarray, lay: Layout) -> np.ndarray:
    """Distance from each pixel to the last place in its image with the same three pixels, else 0."""
    wide = np.concatenate([px, np.zeros(2, np.uint32)]).astype(np.uint64)
    key = wide[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ wide[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ wide[2:] * np.uint64(0x165667B19E3779F9)
    key = (key ^ key >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)
    # image, 40 bits of hash and place in one number (a part's images and places take less than 24): other images have no say in what shares a hash
    image_bits, place_bits = max(lay.n - 1, 1).bit_length(), int(lay.size.max(initial=1)).bit_length()
    high = lay.image.astype(np.uint64) << np.uint64(64 - image_bits)
    key = np.sort(high | key >> np.uint64(24) << np.uint64(place_bits) | lay.at.astype(np.uint64))
    at = (key & np.uint64((1 << place_bits) - 1)).astype(np.int64) + lay.first[(key >> np.uint64(64 - image_bits)).astype(np.int64)]
    met = np.flatnonzero(key[1:] >> np.uint64(place_bits) == key[:-1] >> np.uint64(place_bits))
    p, q = at[met + 1], at[met]
    good = (lay.size[lay.image[p]] - lay.at[p] >= 3) & (px[q] == px[p]) & (wide[q + 1] == wide[p + 1]) & (wide[q + 2] == wide[p + 2])
    out = np.zeros(len(px), np.int32)
    out[p[good]] = (p - q)[good]
    return out


def tokens(px: np.ndarray, lay: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, symbol kind, value, distance) of every token: kind 0 a pixel, 1 a cached one (value: its slot), 2 a copy (value: its length)."""
    steps = Steps(lay.size)
    start = steps.turned(np.concatenate([_repeats(px[p], Layout(lay.rows[i:j])) for i, j, p in lay.parts(PART_PIXELS)]))
    slot = (px * HASH >> np.uint32(32 - CACHE_BITS)).astype(np.int32)
    held = steps.turned(slot).astype(np.int64)
    seen = steps.turned(px)
    base = lay.first[:-1][steps.by]
    cache = np.zeros(lay.n << CACHE_BITS, np.uint32)
    rows = np.arange(lay.n) << CACHE_BITS
    dist = np.zeros(lay.n, np.int32)
    kind, far = np.empty(len(px), np.int8), np.empty(len(px), np.int32)
    for t, a, o in steps.each():
        v, d = seen[o : o + a], dist[:a]
        going = (px.take(base[:a] + t - d) == v) & (d > 0)
        np.copyto(d, start[o : o + a], where=~going)
        h = rows[:a] + held[o : o + a]
        far[o : o + a] = d
        kind[o : o + a] = np.where(d > 0, going + np.int8(2), cache.take(h) == v)
        cache[h] = v
    kind = kind[steps.place]
    where = np.flatnonzero(kind < 3)
    kinds = kind[where]
    length = np.diff(np.append(where, len(px)))  # a copy runs to the next token
    return where, kinds, np.where(kinds == 2, length, np.where(kinds == 1, slot[where], 0)), far[steps.place[where]]


# ---------------------------------------------------------------- prefix codes


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Complete codes for the rows of ``counts``: ceil(-log2 share), then shortened, frequent symbols first, until nothing is left over."""
    order = np.argsort(-counts, axis=1, kind="stable")
    most = max(2, int((counts > 0).sum(1).max(initial=0)))
    order = order[:, :most]
    c = np.take_along_axis(counts, order, 1)
    total = c.sum(1, keepdims=True)
    used = c > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        lens = np.where(used, np.maximum(np.ceil(np.log2(total) - np.log2(c) - 1e-12), 1), 0).astype(np.int64)
    top = int(lens.max(initial=1))
    slack = (1 << top) - np.where(used, 1 << (top - lens), 0).sum(1)
    open_ = np.flatnonzero((used.sum(1) > 1) & (slack > 0))
    while len(open_):
        part, rest = lens[open_], slack[open_]
        for level in range(2, top + 1):
            at = part == level
            n = at.sum(1)
            k = np.minimum(n, rest >> (top - level))
            if k.any():
                first = at.argmax(1)
                place = np.arange(most)[None, :] - first[:, None]
                part -= at & (place < k[:, None])
                rest -= k << (top - level)
        lens[open_], slack[open_] = part, rest
        open_ = open_[rest > 0]
    out = np.zeros(counts.shape, np.uint8)
    np.put_along_axis(out, order, lens.astype(np.uint8), 1)
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, symbol) cells of the used symbols by row, length, symbol, as flat indices, and their codes, first bit lowest."""
    size = lengths.shape[1]
    cell = np.flatnonzero(lengths != 0)
    row = cell // size
    key = np.sort((row << 4 | lengths.ravel()[cell]) * size + cell - row * size)  # row, length, symbol in one number
    group = key // size
    row, ks = group >> 4, group & 15
    share = 1 << (15 - ks)
    room = np.cumsum(share) - share
    first = np.searchsorted(row, np.arange(len(lengths)))
    left = room - room[np.minimum(first, max(len(room) - 1, 0))][row] if len(room) else room
    code = left >> (15 - ks)
    return row * size + key - group * size, _REVERSED[np.minimum(code, (1 << 15) - 1)] >> (15 - ks)


class Fields:
    """Bit fields of all images, section by section; within a section ordered by image."""

    def __init__(self, n: int):
        self.n, self.sections = n, []

    def add(self, image: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
        """Fields of at most 64 bits; ``image`` ascends."""
        self.sections.append((image, value.astype(np.uint64, copy=False), bits.astype(np.int64, copy=False)))

    def each(self, *fields: tuple) -> None:
        """The same (value, bits) fields for every image; a value may be an array."""
        k = len(fields)
        value = np.empty((self.n, k), np.int64)
        for i, (v, _) in enumerate(fields):
            value[:, i] = v
        self.add(np.repeat(np.arange(self.n), k), value.ravel(), np.tile([b for _, b in fields], self.n))

    def bytes(self) -> list[bytes]:
        sizes = np.zeros((len(self.sections) + 1, self.n), np.int64)
        places = []
        for i, (image, _, bits) in enumerate(self.sections):
            ends = np.concatenate([[0], np.cumsum(bits)])
            opens = ends[np.searchsorted(image, np.arange(self.n + 1))]
            sizes[i] = np.diff(opens)
            places.append((ends, opens[:-1]))
        length = (sizes.sum(0) + 7) // 8
        length += length & 1
        first = np.concatenate([[0], np.cumsum(length)])
        begin = np.cumsum(np.concatenate([first[None, :-1] * 8, sizes[:-1]]), axis=0)
        at = np.concatenate([(begin[i] - opens)[image] + ends[:-1] for i, ((image, _, _), (ends, opens)) in enumerate(zip(self.sections, places, strict=True))])
        value = np.concatenate([value for _, value, _ in self.sections])
        low, word = (at & 31).astype(np.uint64), at >> 5
        out = np.zeros((int(first[-1]) * 8 >> 5) + 4)
        wide = value << low  # fields do not overlap, so sums are unions; few fields reach the next words
        out += np.bincount(word, weights=wide & np.uint64(0xFFFFFFFF), minlength=len(out))
        for k, more in ((1, wide >> np.uint64(32)), (2, value >> np.uint64(1) >> (np.uint64(63) - low))):
            some = np.flatnonzero(more)
            out += np.bincount(word[some] + k, weights=more[some], minlength=len(out))
        raw = out.astype("<u4").view(np.uint8)
        return [raw[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


#: A flat code of four bits for the code lengths 0 to 15, in stored order, of 19 times three bits.
_FLAT = sum((4 if s < 16 else 0) << 3 * i for i, s in enumerate(LENGTH_ORDER))
_FLAT_CODE = (_REVERSED[:16] >> 11).astype(np.uint8)


def write_codes(f: Fields, lengths: np.ndarray) -> None:
    """One prefix code for every image."""
    some = lengths > 0
    used = some.sum(1)
    low = np.where(used > 0, some.argmax(1), 0)
    high = np.where(used > 0, lengths.shape[1] - 1 - some[:, ::-1].argmax(1), 0)
    one, two = (used <= 1) & (high < 256), (used == 2) & (high < 256)
    plain = ~(one | two)
    f.add(np.arange(f.n), np.where(one, 0b101 | low << 3, np.where(two, 0b111 | low << 3 | high << 11, 0b11110)), np.where(one, 11, np.where(two, 19, 5)))
    rows = np.flatnonzero(plain)
    top = np.maximum(high + 1, 2)[rows]
    f.add(rows, np.full(len(rows), _FLAT), np.full(len(rows), 57))
    f.add(rows, 1 | 4 << 1 | (top - 2) << 4, np.full(len(rows), 14))
    words = -(-lengths.shape[1] // 16)  # sixteen code lengths in a field
    each = np.zeros((len(rows), words * 16), np.uint8)
    each[:, : lengths.shape[1]] = _FLAT_CODE[lengths[rows]]
    value = (each[:, ::2] | each[:, 1::2] << np.uint8(4)).view("<u8")
    f.add(np.repeat(rows, words), value.ravel(), np.clip(top[:, None] * 4 - np.arange(words) * 64, 0, 64).ravel())


def prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits, their value) of lengths or distances."""
    w = np.maximum(v - 1, 1)
    top = np.floor(np.log2(w)).astype(np.int64)
    extra = np.maximum(top - 1, 0)
    return np.where(v <= 4, v - 1, 2 * top + (w >> extra & 1)), np.where(v <= 4, 0, extra), np.where(v <= 4, 0, w & ((1 << extra) - 1))


def write_pixels(f: Fields, px: np.ndarray, image: np.ndarray, kinds: np.ndarray, values: np.ndarray, far: np.ndarray, cache_bits: int, main: bool) -> None:
    """An entropy-coded image for every image: tokens of pixels ``px`` (one each), ascending by ``image``."""
    f.each(*([(1, 1), (cache_bits, 4)] if cache_bits else [(0, 1)]), *([(0, 1)] if main else []))
    lit, copy = np.flatnonzero(kinds == 0), np.flatnonzero(kinds == 2)
    ls, lk, lv = prefix(values[copy])
    ds, dk, dv = prefix(far[copy].astype(np.int64) + 120)
    pixel, of_lit, of_copy = px[lit], image[lit], image[copy]
    channel = [(pixel >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in CODES]
    first = GREEN + values
    first[lit], first[copy] = channel[0], 256 + ls
    value = bits = None
    for k, (who, symbol, size) in enumerate(((image, first, GREEN + (1 << cache_bits if cache_bits else 0)), *((of_lit, c, 256) for c in channel[1:]), (of_copy, ds, 40))):
        cell = who * size + symbol
        counts = np.bincount(cell, minlength=f.n * size).reshape(f.n, size)
        if k == 0:  # a lone symbol that the short form cannot name gets a companion
            lone = ((counts > 0).sum(1) == 1) & (counts[:, 256:].sum(1) > 0)
            counts[lone, 0] += 1
        lengths = code_lengths(counts)
        write_codes(f, lengths)
        lengths[(lengths > 0).sum(1) <= 1] = 0  # nothing is written for a lone symbol
        cells, codes = canonical(lengths)
        table = np.zeros(f.n * size, np.int32)
        table[cells] = codes << 4 | lengths.ravel()[cells]
        entry = table.take(cell)
        code, wide = (entry >> 4).astype(np.uint64), (entry & 15).astype(np.uint64)
        if k == 0:  # what follows in a token is put above it: at most 60 bits
            value, bits = code, wide
            more, have = value[lit], bits[lit]
        elif k < 4:
            more |= code << have
            have += wide
        else:
            value[lit], bits[lit] = more, have
            more, have = value[copy], bits[copy]
            for v, n in ((lv, lk), (code, wide), (dv, dk)):
                more |= v.astype(np.uint64) << have
                have += n.astype(np.uint64)
            value[copy], bits[copy] = more, have
    f.add(image, value, bits)


def _side(f: Fields, px: np.ndarray, first: np.ndarray) -> None:
    """A small image of literals for every image."""
    image = np.repeat(np.arange(f.n), np.diff(first))
    zero = np.zeros(len(px), np.int64)
    write_pixels(f, px, image, zero, zero, zero, 0, False)


def encode_bodies(c: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """VP8L bodies of images of ``rows`` rows; ``c``: their pixels as (n, 4) bytes R, G, B, A."""
    lay = Layout(rows)
    rest, modes = choose_predictors(c, lay)
    rest, factors = choose_cross_colour(rest, lay)
    px = rest[:, [2, 1, 0, 3]].copy().view(np.uint32).ravel()
    where, kinds, values, far = tokens(px, lay)
    _, first = lay.blocks(BITS)
    modes = (modes.astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000)
    byte = factors.view(np.uint8).astype(np.uint32)
    shares = byte[:, 0] | byte[:, 1] << np.uint32(8) | byte[:, 2] << np.uint32(16) | np.uint32(0xFF000000)
    out = []
    for i, j, _ in lay.parts(WRITE_PIXELS):
        f, blocks = Fields(j - i), first[i : j + 1]
        f.each((0x2F, 8), (WIDTH - 1, 14), (rows[i:j] - 1, 14), (1, 1), (0, 3))
        for kind, side in ((PREDICTOR, modes), (CROSS_COLOUR, shares)):
            f.each((1 | kind << 1, 3), (BITS - 2, 3))
            _side(f, side[blocks[0] : blocks[-1]], blocks)
        f.each((0, 1))
        mine = slice(*np.searchsorted(where, lay.first[[i, j]]).tolist())
        write_pixels(f, px[where[mine]], lay.image[where[mine]] - i, kinds[mine], values[mine], far[mine], CACHE_BITS, True)
        out += f.bytes()
    return out


# ---------------------------------------------------------------- decoder


class Readers:
    """A bit position in each of many streams."""

    def __init__(self, bodies: list[bytes]):
        self.raw = np.frombuffer(b"".join(bodies) + b"\0" * 8, np.uint8)
        raw = self.raw.astype(np.uint32)
        self.word = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
        sizes = np.array([len(b) for b in bodies], np.int64)
        self.end = np.cumsum(sizes) * 8
        self.pos = self.end - sizes * 8
        self.last = len(self.word) - 1

    def peek(self, rows: np.ndarray) -> np.ndarray:
        """At least 25 bits from each position."""
        p = self.pos[rows]
        return self.word[np.minimum(p >> 3, self.last)] >> (p & 7).astype(np.uint32)

    def read(self, rows: np.ndarray, bits) -> np.ndarray:
        """``bits`` (one number, or one for each row; at most 24) from each row's stream."""
        n = np.asarray(bits, np.int64)
        out = self.peek(rows).astype(np.int64) & ((1 << n) - 1)
        self.pos[rows] += n
        return out

    def check(self) -> None:
        if (self.pos > self.end).any():
            raise ValueError("truncated stream")


class Tables:
    """Look-up tables of one code for every row: entries symbol << 4 | length, indexed by the next ``depth`` bits."""

    def __init__(self, lengths: np.ndarray):
        n, size = lengths.shape
        some = lengths > 0
        lone = some.sum(1) <= 1
        depth = np.where(lone, 0, lengths.max(1)).astype(np.int64)
        self.depth, self.mask = depth, (1 << depth) - 1
        self.first = np.empty(n, np.int64)
        self.entry = np.empty(int((1 << depth).sum()), np.uint16)
        filled = 0
        for d in np.flatnonzero(np.bincount(depth)).tolist():
            rows = np.flatnonzero(depth == d)
            self.first[rows] = filled + (np.arange(len(rows)) << d)
            part = self.entry[filled : filled + (len(rows) << d)]
            filled += len(part)
            if not d:
                part[:] = some[rows].argmax(1) << 4
                continue
            # in the order of the codes, first bit highest, each symbol fills a run
            cells, _ = canonical(lengths[rows])
            ks = lengths[rows].ravel()[cells].astype(np.int64)
            runs = 1 << (d - ks)
            if (np.bincount(cells // size, weights=runs, minlength=len(rows)) != 1 << d).any():
                raise ValueError("incomplete prefix code")
            np.take(np.repeat((cells % size << 4 | ks).astype(np.uint16), runs).reshape(-1, 1 << d), _REVERSED[: 1 << d] >> (15 - d), axis=1, out=part.reshape(-1, 1 << d))

    def next(self, r: Readers, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The next symbol of the streams ``rows``; ``which``: their rows of the tables."""
        v = self.entry[self.first[which] + (r.peek(rows).astype(np.int64) & self.mask[which])].astype(np.int64)
        r.pos[rows] += v & 15
        return v >> 4


def read_codes(r: Readers, size: np.ndarray, most: int) -> np.ndarray:
    """Code lengths (n, most) of one code from every stream; ``size``: each alphabet's."""
    n = len(size)
    every = np.arange(n)
    lengths = np.zeros((n, max(most, 256)), np.uint8)
    simple = r.read(every, 1) == 1
    s = np.flatnonzero(simple)
    if len(s):
        two, wide = r.read(s, 1) == 1, r.read(s, 1)
        first = r.read(s, 1 + 7 * wide)
        lengths[s, first] = 1
        second = r.read(s[two], 8)
        lengths[s[two], second] = 1
    s = np.flatnonzero(~simple)
    if len(s):
        of = np.zeros((len(s), 19), np.uint8)
        count = 4 + r.read(s, 4)
        for i, symbol in enumerate(LENGTH_ORDER):
            some = np.flatnonzero(i < count)
            if len(some):
                of[some, symbol] = r.read(s[some], 3)
        table = Tables(of)
        limited = r.read(s, 1) == 1
        left = size[s].copy()
        some = np.flatnonzero(limited)
        if len(some):
            wide = 2 + 2 * r.read(s[some], 3)
            left[some] = 2 + r.read(s[some], wide)
        if (left > size[s]).any():
            raise ValueError("too many code lengths")
        at, before = np.zeros(len(s), np.int64), np.full(len(s), 8, np.int64)
        live = np.flatnonzero(left > 0)
        while len(live):
            left[live] -= 1
            symbol = table.next(r, s[live], live)
            plain = symbol < 16
            rows, v = live[plain], symbol[plain]
            lengths[s[rows], at[rows]] = v
            before[rows] = np.where(v > 0, v, before[rows])
            at[rows] += 1
            if not plain.all():
                rows, v = live[~plain], symbol[~plain]
                times = np.array([3, 3, 11])[v - 16] + r.read(s[rows], np.array([2, 3, 7])[v - 16])
                if (at[rows] + times > size[s[rows]]).any():
                    raise ValueError("code lengths overrun")
                k = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                lengths[np.repeat(s[rows], times), np.repeat(at[rows], times) + k] = np.repeat(np.where(v == 16, before[rows], 0), times)
                at[rows] += times
            live = live[(left[live] > 0) & (at[live] < size[s[live]])]
    r.check()
    return lengths[:, :most]


def read_pixels(r: Readers, size: np.ndarray, main: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ARGB pixels of all images, first pixel of each) of entropy-coded images of ``size`` pixels."""
    n = len(size)
    every = np.arange(n)
    has = np.flatnonzero(r.read(every, 1) == 1)
    cache_bits = np.zeros(n, np.int64)
    cache_bits[has] = r.read(has, 4)
    if (cache_bits > 11).any() or (cache_bits[has] == 0).any():
        raise ValueError("bad colour cache")
    if main and r.read(every, 1).any():
        raise NotImplementedError("meta prefix groups")
    slots = np.where(cache_bits > 0, 1 << cache_bits, 0)
    green = GREEN + slots
    codes = [Tables(read_codes(r, np.full(n, k) if k else green, k or int(green.max(initial=GREEN)))) for k in (0, 256, 256, 256, 40)]
    steps = Steps(size)
    by, longest, opens = steps.by, steps.longest, steps.opens
    out = np.zeros(int(opens[-1]), np.uint32)
    room = int(slots.max(initial=1)) or 1
    cache = np.zeros(n * room, np.uint32)
    rows = np.arange(n) * room
    cached, shift = cache_bits[by] > 0, (32 - cache_bits[by]).astype(np.uint32)
    every_cached = bool(cached.all())
    if every_cached and n and (shift == shift[0]).all():
        shift = shift[:1]
    left, dist = np.zeros(n, np.int64), np.ones(n, np.int64)
    copying = False
    # the state of the images in the order ``by``; a step takes less than ten bytes of a stream, so this much padding bounds all reads
    half = np.concatenate([r.raw, np.zeros(10 * longest + 16 + len(r.raw) % 2, np.uint8)]).view("<u2").astype(np.int64)
    word = half[:-3] | half[1:-2] << 16 | half[2:-1] << 32 | half[3:] << 48  # at each second byte; 49 bits after any bit of it
    pos, wide = r.pos[by], size[by]
    place, mask = [c.first[by] for c in codes], [c.mask[by] for c in codes]
    at_once = sum(int(c.depth.max(initial=0)) for c in codes[:4]) <= 49  # the four codes of a pixel are in one word

    def ahead(p: np.ndarray) -> np.ndarray:
        return word.take(p >> 4) >> (p & 15)

    def look(k: int, i: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Entries of code k for the images ``i`` whose next bits are ``w``."""
        return codes[k].entry.take(place[k].take(i) + (w & mask[k].take(i)))

    def more(p: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length or distance of a prefix symbol, the bits after it)."""
        extra = np.where(symbol < 4, 0, (symbol - 2) >> 1)
        low = ahead(p) & ((1 << extra) - 1)
        return np.where(symbol < 4, symbol + 1, ((2 + (symbol & 1)) << extra) + low + 1), p + extra

    for t, a, o in steps.each():
        here = out[o : o + a]
        ask = np.flatnonzero(left[:a] == 0) if copying else np.arange(a)
        p = pos.take(ask)
        w = ahead(p)
        e = look(0, ask, w)
        used = (e & 15).astype(np.int64)
        p += used
        w >>= used
        s = e >> 4
        lit = s < 256
        whole = bool(lit.all())
        if whole:
            li, q, value = ask, p, s.astype(np.uint32) << np.uint32(8)
        else:
            some = np.flatnonzero(lit)
            li, q, w, value = ask.take(some), p.take(some), w.take(some), s.take(some).astype(np.uint32) << np.uint32(8)
        if len(li):
            for k, shift_of in ((1, 16), (2, 0), (3, 24)):
                e = look(k, li, w if at_once else ahead(q))
                used = (e & 15).astype(np.int64)
                q += used
                if at_once:
                    w >>= used
                value |= (e >> 4).astype(np.uint32) << np.uint32(shift_of)
            here[li] = value
        if not whole:
            p[some] = q
            hit = np.flatnonzero(s >= GREEN)
            if len(hit):
                i = ask.take(hit)
                here[i] = cache.take(rows.take(i) + s.take(hit) - GREEN)
            copy = np.flatnonzero((s >= 256) & (s < GREEN))
            if len(copy):
                ci = ask.take(copy)
                length, q = more(p.take(copy), s.take(copy).astype(np.int64) - 256)
                e = look(4, ci, ahead(q)).astype(np.int64)
                d, p[copy] = more(q + (e & 15), e >> 4)
                left[ci], dist[ci] = length, np.where(d > 120, d - 120, _NEAR[np.minimum(d, 120) - 1])
                if (dist[ci] > t).any() or (length + t > wide[ci]).any():
                    raise ValueError("bad back-reference")
                copying = True
        pos[ask] = p
        if copying:
            going = np.flatnonzero(left[:a])
            here[going] = out.take(opens.take(t - dist.take(going)) + going)
            left[going] -= 1
            copying = len(going) > 0
        if every_cached:
            cache[rows[:a] + (here * HASH >> shift[:a])] = here
        else:
            i = np.flatnonzero(cached[:a])
            v = here.take(i)
            cache[rows.take(i) + (v * HASH >> shift.take(i))] = v
    r.pos[by] = pos
    r.check()
    return out.take(steps.place), np.concatenate([[0], np.cumsum(size)])


def undo_predictors(c: np.ndarray, lay: Layout, bits: int, modes: np.ndarray, first_block: np.ndarray) -> np.ndarray:
    """Pixels (n, 4) from residuals, one pixel of every image at a time."""
    steps = Steps(lay.size)
    blocks, opens = first_block[:-1][steps.by], steps.opens.tolist()
    across = -(-WIDTH >> bits)
    whole = steps.turned(np.ascontiguousarray(c).view(np.uint32).ravel())  # four bytes at a time where pixels are only moved
    out = whole.view(np.uint8).reshape(-1, 4)
    groups: list[tuple] = []
    for t, a, o in steps.each():
        y, x = divmod(t, WIDTH)
        here = out[o : o + a]
        if not t:
            here += np.array([0, 0, 0, 255], np.uint8)
            continue
        if not y or not x:
            o = opens[t - (1 if not y else WIDTH)]
            here += out[o : o + a]
            continue
        if x == 1 or not x & (1 << bits) - 1:  # images have whole rows, so those of a block stay the same along a row
            mode = modes[blocks[:a] + (y >> bits) * across + (x >> bits)]
            groups = [(m, np.flatnonzero(mode == m)) for m in np.flatnonzero(np.bincount(mode, minlength=16)).tolist()]
        for m, i in groups:
            if m == 0 or m > 13:
                here[i, 3] += 255
                continue
            left, top, right, corner = (whole[opens[t - d] : opens[t - d] + a].take(i).view(np.uint8).reshape(-1, 4) for d in (1, WIDTH, WIDTH - 1, WIDTH + 1))
            whole[o + i] = (here.take(i, axis=0) + predict(m, left, top, right, corner)).view(np.uint32).ravel()
    return whole.take(steps.place).view(np.uint8).reshape(-1, 4)


def undo_cross_colour(c: np.ndarray, block: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Give red and blue their shares of green and red back; factors: ARGB pixels of the blocks."""
    out = c.copy()
    for lo in range(0, len(c), WRITE_PIXELS):
        part = slice(lo, lo + WRITE_PIXELS)
        share = factors.take(block[part]).view(np.int8).reshape(-1, 4).astype(np.int16)
        green = c[part, 1].view(np.int8).astype(np.int16)
        out[part, 0] += (share[:, 0] * green >> 5).astype(np.uint8)
        red = out[part, 0].view(np.int8).astype(np.int16)
        out[part, 2] += (share[:, 1] * green >> 5).astype(np.uint8) + (share[:, 2] * red >> 5).astype(np.uint8)
    return out


def decode_bodies(bodies: list[bytes]) -> list[np.ndarray]:
    """Images (rows, WIDTH, 4) R, G, B, A of VP8L bodies of WIDTH pixels a row, all with the same transforms in the same order."""
    r = Readers(bodies)
    every = np.arange(len(bodies))
    if (r.read(every, 8) != 0x2F).any() or (r.read(every, 14) != WIDTH - 1).any():
        raise ValueError("bad signature or width")
    lay = Layout(r.read(every, 14) + 1)
    r.read(every, 1)
    if r.read(every, 3).any():
        raise ValueError("unknown version")
    todo = []
    while (more := r.read(every, 1)).any():
        kind = r.read(every, 2)
        if not more.all() or (kind != kind[0]).any() or kind[0] in [k for k, *_ in todo]:
            raise NotImplementedError("different transforms")
        if kind[0] == PALETTE:
            raise NotImplementedError("palette")
        if kind[0] == SUBTRACT_GREEN:
            todo.append((SUBTRACT_GREEN,))
            continue
        bits = r.read(every, 3) + 2
        if (bits != bits[0]).any():
            raise NotImplementedError("different blocks")
        block, first = lay.blocks(int(bits[0]))
        side, _ = read_pixels(r, np.diff(first), False)
        todo.append((int(kind[0]), int(bits[0]), side, block, first))
    px, _ = read_pixels(r, lay.size, True)
    c = px.view(np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]]
    for kind, *how in reversed(todo):
        if kind == SUBTRACT_GREEN:
            c[:, 0] += c[:, 1]
            c[:, 2] += c[:, 1]
        elif kind == CROSS_COLOUR:
            c = undo_cross_colour(c, how[2], how[1])
        else:
            c = undo_predictors(c, lay, how[0], (how[1] >> np.uint32(8) & np.uint32(15)).astype(np.int64), how[3])
    return [c[a:b].reshape(-1, WIDTH, 4) for a, b in zip(lay.first[:-1], lay.first[1:], strict=True)]


# ---------------------------------------------------------------- payloads


def _file(body: bytes) -> bytes:
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


def _runs(sizes: list[int]):
    """(i, j) runs of items of about STEP_BYTES."""
    i, held = 0, 0
    for j, n in enumerate(sizes):
        if held and held + n > STEP_BYTES:
            yield i, j
            i, held = j, 0
        held += n
    if i < len(sizes):
        yield i, len(sizes)


def _files(parts: list[bytes]) -> list[bytes]:
    rows = np.array([len(p) // (4 * WIDTH) for p in parts], np.int64)
    c = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 4)
    lay = Layout(rows)
    pairs = np.sort(lay.image.astype(np.uint64) << np.uint64(32) | c.copy().view(np.uint32).ravel())
    new = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
    colours = np.bincount((pairs[new] >> np.uint64(32)).astype(np.int64), minlength=len(parts))
    many = np.flatnonzero(colours > COLOURS)
    files: list[bytes] = [b""] * len(parts)
    if len(many):
        bodies = encode_bodies(c[np.isin(lay.image, many)], rows[many])
        for i, body in zip(many.tolist(), bodies, strict=True):
            files[i] = _file(body)
    for i in np.flatnonzero(colours <= COLOURS).tolist():
        files[i] = webp.encode(c[lay.first[i] : lay.first[i + 1]].reshape(-1, WIDTH, 4), "palette")
    return files


def store(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 192 bytes) as one or more .webp files of at most ROWS rows, one after another."""
    step = ROWS * WIDTH * 4
    parts = [p[i : i + step] for p in payloads for i in range(0, len(p), step)]
    files = [f for i, j in _runs([len(p) for p in parts]) for f in _files(parts[i:j])]
    counts = [-(-len(p) // step) for p in payloads]
    ends = np.cumsum(counts)
    return [b"".join(files[e - k : e]) for e, k in zip(ends.tolist(), counts, strict=True)]


def images(media: list[bytes]) -> list[list[np.ndarray]]:
    """The decoded images of every stored payload."""
    out: list[list] = []
    batch, places = [], []
    for m in media:
        mine, at = [], 0
        while at < len(m):
            size = 8 + struct.unpack("<I", m[at + 4 : at + 8])[0]
            if m[at : at + 4] != b"RIFF" or m[at + 8 : at + 16] != b"WEBPVP8L" or at + size > len(m):
                raise ValueError("not a lossless WebP file")
            body = m[at + 20 : at + size]
            if len(body) > 5 and body[5] & 1 and body[5] >> 1 & 3 == PALETTE:
                mine.append(webp.decode(m[at : at + size]))
            else:
                places.append((len(out), len(mine)))
                batch.append(body)
                mine.append(None)
            at += size
        out.append(mine)
    decoded = (x for i, j in _runs([len(b) for b in batch]) for x in decode_bodies(batch[i:j]))
    for (i, k), image in zip(places, decoded, strict=True):
        out[i][k] = image
    return out
