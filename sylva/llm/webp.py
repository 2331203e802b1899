"""Media columns: lossless WebP (VP8L), decoded to pixel arrays and written back.

``decode`` reads any still VP8L stream: simple and normal prefix codes,
meta prefix groups, back-references, the colour cache, and the inverse of the
predictor, cross-colour, subtract-green and palette transforms, in the order
in which the stream lists them.

``encode`` writes bytes as opaque grey pixels, a sample each; a row
that the payload doesn't fill ends in transparent ones, which carry none of it. Images of up to ``FEW`` colours get a palette, others
a predictor mode for each tile and the cross-colour factors that take green out of red and blue; what is left is written as literals, back-references and cache hits
in prefix codes made for them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache, cached_property, lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: order of the code length codes, and the pixel
# offsets of the 120 short distance codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
HASH, SIDE = 0x1E35A7BD, 16384
#: Bits of a stream that are looked at together.
STRETCH = 1 << 16
#: Pixels of a row; colours that a palette is made for; bits of the colour cache; longest prefix code; bits of a tile's side; shortest repeat that is a reference.
ROW, FEW, CACHE, LONGEST, TILE, REPEAT = 192, 16, 1, 11, 9, 8
#: Predictor modes that need no pixel of their own row but the left one, and those that ``encode`` chooses from. The left neighbour, which keeps
#: repeats alike, is left for another guess only if that saves such a share of the bits.
ROW_MODES, MODES, GAIN = (1, 2, 3, 4, 8, 9), (1, 2, 4), 0.03


class Bits:
    """Least significant bit first; reading past the end is an error."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data + bytes(8), 0, 8 * len(data)

    def peek(self) -> int:
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 8], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        v = self.peek() & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return v

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends early")


@cache
def _reversal(width: int) -> np.ndarray:
    """Each number of ``width`` bits with its bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(width):
        out = np.concatenate([out << 1, out << 1 | 1])
    return out


@cache
def _turned(width: int) -> list[int]:
    return _reversal(width).tolist()


@cache
def _places(n: int) -> np.ndarray:
    return np.arange(n)


class Code:
    """Canonical prefix code of ``width`` bits at most. ``table`` is indexed by the next ``width`` bits: symbol times 16 and the bits it takes; ``array`` is the same, if it was made first."""

    array: np.ndarray | None = None

    @cached_property
    def table(self) -> list[int]:
        return self.array.tolist()

    def __init__(self, lengths: list[int]) -> None:
        sizes = np.array(lengths)
        used = np.flatnonzero(sizes)
        if len(used) <= 1:
            self.width, self.table = 0, [int(used[0]) << 4 if len(used) else 0]
            return
        used = used[np.argsort(sizes[used], kind="stable")]
        sizes = sizes[used]
        self.width = int(sizes[-1])
        spans = 1 << (self.width - sizes)
        if spans.sum() != 1 << self.width:
            raise ValueError("a prefix code isn't complete")
        self.array = np.repeat((used << 4 | sizes).astype(np.uint16), spans)[_reversal(self.width)]

    @classmethod
    def short(cls, lengths: list[int]) -> Code:
        """Of few symbols and up to seven bits: built symbol by symbol."""
        own = cls.__new__(cls)
        used = sorted((n, x) for x, n in enumerate(lengths) if n)
        if len(used) <= 1:
            own.width, own.table = 0, [used[0][1] << 4 if used else 0]
            return own
        own.width = used[-1][0]
        full, at = 1 << own.width, 0
        if sum(full >> n for n, _ in used) != full:
            raise ValueError("a prefix code isn't complete")
        own.table, turned = [0] * full, _turned(own.width)
        for n, x in used:
            own.table[turned[at] :: 1 << n] = [x << 4 | n] * (full >> n)
            at += full >> n
        return own

    @classmethod
    def simple(cls, symbols: list[int]) -> Code:
        """Of one symbol, which takes no bits, or two."""
        own = cls.__new__(cls)
        symbols = sorted(set(symbols))
        own.width = len(symbols) - 1
        own.table = [x << 4 | own.width for x in symbols]
        return own


def _code(bits: Bits, size: int) -> Code:
    head = bits.peek()
    if head & 1:
        two, n = head >> 1 & 1, 8 if head & 4 else 1
        bits.skip(3 + n + 8 * two)
        found = [head >> 3 & ((1 << n) - 1)] + ([head >> 3 + n & 255] if two else [])
        if max(found) >= size:
            raise ValueError("a symbol is too large")
        return Code.simple(found)
    known = 4 + (head >> 1 & 15)
    bits.skip(5)
    own, head = [0] * 19, bits.peek()  # 57 bits at the most
    for k in LENGTH_ORDER[:known]:
        own[k] = head & 7
        head >>= 3
    bits.skip(3 * known)
    code, left = Code.short(own), size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    lengths: list[int] = []
    table, mask, last, where, have, acc = code.table, (1 << code.width) - 1, 8, bits.at, 0, 0
    while len(lengths) < size and left:
        left -= 1
        if have < 14:
            have, acc = 100, int.from_bytes(bits.data[where >> 3 : (where >> 3) + 14], "little") >> (where & 7)
        t = table[acc & mask]
        n, s = t & 15, t >> 4
        acc >>= n
        if s < 16:
            lengths.append(s)
            last = s or last
        else:
            least, extra = ((3, 2), (3, 3), (11, 7))[s - 16]
            lengths += [last if s == 16 else 0] * (least + (acc & ((1 << extra) - 1)))
            acc >>= extra
            n += extra
        have -= n
        where += n
    bits.at = where
    if where > bits.end:
        raise ValueError("the stream ends early")
    if len(lengths) > size:
        raise ValueError("too many code lengths")
    return Code(lengths)


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB words, row by row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    tile, groups, of = 0, 1, None
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across = (width + (1 << tile) - 1) >> tile
        of = (_image(bits, across, (height + (1 << tile) - 1) >> tile, False) >> 8) & 0xFFFF
        groups = int(of.max()) + 1
    every = [[_code(bits, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(groups)]
    total = width * height
    green, red, blue, alpha, far = every[0]
    if groups == 1 and total > 64 and not red.width | blue.width | alpha.width:  # red, blue and alpha take no bits
        rest = alpha.table[0] >> 4 << 24 | red.table[0] >> 4 << 16 | blue.table[0] >> 4
        found = _greens(bits, green, far, rest, cache_bits, width, total)
        if found is not None:
            return np.uint32(rest) | found.astype(np.uint32) << np.uint32(8)
    codes = [[x for c in own for x in (c.table, (1 << c.width) - 1)] for own in every]
    out, cache, at, cached = [0] * total, [0] * (1 << cache_bits), 0, 0
    data, where, shift = bits.data, bits.at, 32 - cache_bits
    acc, have, limit = 0, 0, bits.end
    green, green_mask, red, red_mask, blue, blue_mask, alpha, alpha_mask, far, far_mask = codes[0]
    while at < total:
        if of is not None:
            green, green_mask, red, red_mask, blue, blue_mask, alpha, alpha_mask, far, far_mask = codes[of[(at // width >> tile) * across + (at % width >> tile)]]
        if have < 60:  # a pixel takes 60 bits at most, a reference as many
            have, acc = 184, int.from_bytes(data[where >> 3 : (where >> 3) + 24], "little") >> (where & 7)
        t = green[acc & green_mask]
        n, s = t & 15, t >> 4
        if s < 256:
            r = red[acc >> n & red_mask]
            n += r & 15
            b = blue[acc >> n & blue_mask]
            n += b & 15
            t = alpha[acc >> n & alpha_mask]
            n += t & 15
            out[at] = t >> 4 << 24 | r >> 4 << 16 | s << 8 | b >> 4
            at += 1
            acc >>= n
            have -= n
            where += n
        elif s < 280:
            length, k = _extra(s - 256, acc >> n)
            n += k
            t = far[acc >> n & far_mask]
            n += t & 15
            d, k = _extra(t >> 4, acc >> n)
            n += k
            if d > 120:
                d -= 120
            else:
                dx, dy = NEAR[d - 1]
                d = max(1, dx + dy * width)
            if d > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            if d >= length:
                out[at : at + length] = out[at - d : at - d + length]
            else:
                out[at : at + length] = (out[at - d : at] * (length // d + 1))[:length]
            at += length
            acc >>= n
            have -= n
            where += n
        else:
            for v in out[cached:at]:
                cache[(HASH * v & 0xFFFFFFFF) >> shift] = v
            cached = at
            out[at] = cache[s - 280]
            at += 1
            acc >>= n
            have -= n
            where += n
        if where > limit:
            raise ValueError("the stream ends early")
    bits.at = where
    if where > limit:
        raise ValueError("the stream ends early")
    return np.array(out, np.uint32)


@lru_cache(64)
def _slots_beside(rest: int, cache_bits: int) -> tuple[int, ...]:
    """Cache slot of each green value beside those other channels."""
    return tuple(((rest | g << 8) * HASH & 0xFFFFFFFF) >> (32 - cache_bits) for g in range(256))


def _greens(bits: Bits, of_green: Code, of_far: Code, rest: int, cache_bits: int, width: int, total: int) -> np.ndarray | None:
    """The green values of an image whose other channels stay the same; None if a cache entry is read that no pixel has set.

    What stands at a place of the stream is looked up for all places of a stretch at once, whether a symbol starts there or not; then the symbols are
    followed eight at a time by tables of where each place leads to, and the literals among them are put down together, references and cache hits in turn.
    """
    green = of_green.array if of_green.array is not None else np.array(of_green.table, np.uint16)
    mask, far, far_mask = (1 << of_green.width) - 1, of_far.table, (1 << of_far.width) - 1
    sizes = (green & np.uint16(15)).astype(np.uint8)
    symbols_of = green >> np.uint16(4)
    sizes[(symbols_of > 255) & (symbols_of < 280)] = 0  # a reference: how far it goes is read on the way
    data = bits.data + bytes(STRETCH // 8 + 16)
    raw = np.frombuffer(data, np.uint8)
    slots = _slots_beside(rest, cache_bits) if cache_bits else ()
    out, done, start = np.zeros(total, np.uint8), 0, bits.at
    view = memoryview(out)
    while done < total:
        if start > bits.end:
            raise ValueError("the stream ends early")
        first, p = start >> 3, start & 7
        n = min(STRETCH, bits.end - 8 * first + 8)
        part = raw[first : first + (n + 7 >> 3) + 2].astype(np.uint32)
        near = part[:-2] | part[1:-1] << np.uint32(8) | part[2:] << np.uint32(16)
        own = (near[:, None] >> np.arange(8, dtype=np.uint32) & np.uint32(mask)).ravel().astype(np.intp)
        refs: dict[int, tuple[int, int]] = {}
        room = total - done
        if not mask and symbols_of[0] < 256:  # one literal that takes no bits
            taken = np.full(room, p)
        else:
            # where each place leads to; a reference and what lies behind the stretch lead to themselves
            one = _places(STRETCH + 32)[: n + 16].copy()
            one[:n] += sizes.take(own[:n])
            two = one.take(one)
            four = two.take(two)
            hop, anchors = memoryview(four.take(four)), []
            append = anchors.append
            while True:
                while (to := hop[p]) != p:
                    append(p)
                    p = to
                if p >= n or len(refs) >= room:
                    break
                append(p)
                t = int(green[own[p]])
                s, d = t >> 4, t & 15
                if s > 279:
                    raise ValueError("a code of cache entries only")
                at = 8 * first + p + d
                window = int.from_bytes(data[at >> 3 : (at >> 3) + 12], "little") >> (at & 7)
                m, k = _extra(s - 256, window)
                t = far[window >> k & far_mask]
                k += t & 15
                away, more = _extra(t >> 4, window >> k)
                if away > 120:
                    away -= 120
                else:
                    x, y = NEAR[away - 1]
                    away = max(1, x + y * width)
                refs[p] = m, away
                p += d + k + more
                if p >= n or not d + k + more:
                    break
            steps = np.empty((len(anchors), 8), np.int64)
            steps[:, 0] = anchors
            steps[:, 1] = one.take(steps[:, 0])
            steps[:, 2:4] = two.take(steps[:, :2])
            steps[:, 4:] = four.take(steps[:, :4])
            taken = steps.ravel()
            taken = taken[np.append(True, taken[1:] > taken[:-1])]
            taken = taken[: int(np.searchsorted(taken, n))]
        lengths = np.ones(len(taken), np.int64)
        if refs:
            at_refs = np.searchsorted(taken, list(refs))
            lengths[at_refs] = [m for m, _ in refs.values()]
        ends = done + np.cumsum(lengths)
        kept = min(len(taken), int(np.searchsorted(ends, total)) + 1)
        if ends[kept - 1] > total:
            raise ValueError("a back-reference leaves the image")
        if kept < len(taken):
            p = int(taken[kept])
        start = 8 * first + p
        symbols, begins = symbols_of[own[taken[:kept]]], ends[:kept] - lengths[:kept]
        plain = symbols < 256
        out[begins[plain]] = symbols[plain]
        away = {i: d for i, (_, d) in zip(at_refs.tolist(), refs.values())} if refs else {}
        for k in np.flatnonzero(~plain).tolist():
            i, s = int(begins[k]), int(symbols[k])
            if s > 279:
                j = i - 1
                while j >= 0 and slots[view[j]] != s - 280:
                    j -= 1
                if j < 0:
                    return None
                view[i] = view[j]
                continue
            d, m = away[k], int(lengths[k])
            if d > i:
                raise ValueError("a back-reference leaves the image")
            view[i : i + m] = view[i - d : i - d + m] if d >= m else (bytes(view[i - d : i]) * (m // d + 1))[:m]
        done = int(ends[kept - 1])
    if start > bits.end:
        raise ValueError("the stream ends early")
    bits.at = start
    return out


def _extra(prefix: int, acc: int) -> tuple[int, int]:
    """A length or distance of which ``acc`` holds the further bits, and how many they are."""
    if prefix < 4:
        return prefix + 1, 0
    k = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << k) + (acc & ((1 << k) - 1)) + 1, k


def _bytes(argb: np.ndarray) -> np.ndarray:
    """ARGB words as bytes by channel: alpha, red, green, blue."""
    return np.ascontiguousarray(argb, ">u4").view(np.uint8).reshape(*argb.shape, 4)


def _words(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels, np.uint8).view(">u4")[..., 0].astype(np.uint32)


def predicted(mode: int, left: list[int], top: list[int], top_left: list[int], top_right: list[int]) -> list[int]:
    """The guess of a mode for one pixel, by channel (alpha, red, green, blue)."""
    mean = lambda a, b: [x + y >> 1 for x, y in zip(a, b)]
    clip = lambda v: 0 if v < 0 else 255 if v > 255 else v
    if mode == 0 or mode > 13:
        return [255, 0, 0, 0]
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, top_left))
        to_top = sum(abs(a - c) for a, c in zip(left, top_left))
        return left if to_left < to_top else top
    if mode == 12:
        return [clip(a + t - c) for a, t, c in zip(left, top, top_left)]
    if mode == 13:
        return [clip(m + ((m - c) // 2 if m >= c else -((c - m) // 2))) for m, c in zip(mean(left, top), top_left)]
    if mode < 5:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    return mean(*{6: (left, top_left), 7: (left, top), 8: (top_left, top), 9: (top, top_right)}[mode])


BLACK = np.array([255, 0, 0, 0], np.uint8)


def _neighbours(flat: np.ndarray, at: int, n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pixels above, above to the left and above to the right of ``n`` pixels from ``at`` on."""
    return flat[at - width : at - width + n], flat[at - width - 1 : at - width - 1 + n], flat[at - width + 1 : at - width + 1 + n]


def _mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint16) + b) >> 1).astype(np.uint8)


def _above(mode: int, top: np.ndarray, top_left: np.ndarray, top_right: np.ndarray) -> np.ndarray:
    """The guess of a mode that looks at the row above only."""
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    return _mean(top_left, top) if mode == 8 else _mean(top, top_right)


def _unpredict(argb: np.ndarray, tile: int, modes: np.ndarray) -> np.ndarray:
    """Row by row: stretches of a mode at once where it looks at the row above or is a running sum, else pixel by pixel."""
    height, width = argb.shape
    rest = _bytes(argb).reshape(-1, 4)
    out = np.zeros((height * width + 1, 4), np.uint8)
    out[:width] = np.cumsum(rest[:width], axis=0, dtype=np.uint8) + BLACK
    left_only = (modes == 1).all(axis=1)
    y = 1
    while y < height:
        row = y * width
        if left_only[y >> tile]:  # as many rows as go on so, by running sums down the first column and along the rows
            end = y
            while end < height and left_only[end >> tile]:
                end = min(height, ((end >> tile) + 1) << tile)
            part = rest[row : end * width].reshape(end - y, width, 4).copy()
            part[:, 0] = np.cumsum(part[:, 0], axis=0, dtype=np.uint8) + out[row - width]
            out[row : end * width] = np.cumsum(part, axis=1, dtype=np.uint8).reshape(-1, 4)
            y = end
            continue
        y += 1
        out[row] = rest[row] + out[row - width]
        x, tiles = 1, 0
        for mode, same in groupby(modes[y - 1 >> tile].tolist()):
            tiles += len(list(same))
            end = min(width, tiles << tile)
            at, n = row + x, end - x
            if n <= 0:
                continue
            x = end
            if mode == 1:
                out[at : at + n] = np.cumsum(rest[at : at + n], axis=0, dtype=np.uint8) + out[at - 1]
            elif mode in ROW_MODES:
                out[at : at + n] = rest[at : at + n] + _above(mode, *_neighbours(out, at, n, width))
            elif mode == 0 or mode > 13:
                out[at : at + n] = rest[at : at + n] + BLACK
            else:
                _one_by_one(mode, rest, out, at, n, width)
    return _words(out[:-1]).reshape(height, width)


def _one_by_one(mode: int, rest: np.ndarray, out: np.ndarray, at: int, n: int, width: int) -> None:
    left = out[at - 1].tolist()
    found = []
    for own, top, top_left, top_right in zip(rest[at : at + n].tolist(), *(a.tolist() for a in _neighbours(out, at, n, width))):
        left = [v + p & 255 for v, p in zip(own, predicted(mode, left, top, top_left, top_right))]
        found.append(left)
        # the last pixel's neighbour above to the right is the first of its own row, which stands already
    out[at : at + n] = found


def _delta(factor: np.ndarray, channel: np.ndarray) -> np.ndarray:
    return (factor.astype(np.int16) * channel >> 5).astype(np.uint8)


def _uncross(argb: np.ndarray, tile: int, factors: np.ndarray) -> np.ndarray:
    height, width = argb.shape
    c = _bytes(argb).copy()
    f = _bytes(factors).view(np.int8)
    if (factors == factors[0, 0]).all():
        f = f[0, 0]
    else:
        f = f[np.arange(height)[:, None] >> tile, np.arange(width)[None, :] >> tile]
    green = c[..., 2].view(np.int8)
    c[..., 1] += _delta(f[..., 3], green)
    c[..., 3] += _delta(f[..., 2], green) + _delta(f[..., 1], c[..., 1].view(np.int8))
    return _words(c)


def decode(data: bytes) -> np.ndarray:
    """ARGB words of a lossless WebP file, ``uint32[height, width]``; ValueError if it isn't one."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at, end = 12, min(len(data), 8 + struct.unpack("<I", data[4:8])[0])
    while at + 8 <= end and data[at : at + 4] != b"VP8L":
        n = struct.unpack("<I", data[at + 4 : at + 8])[0]
        at += 8 + n + (n & 1)
    if at + 8 > end:
        raise ValueError("there is no lossless image in it")
    n = struct.unpack("<I", data[at + 4 : at + 8])[0]
    bits = Bits(data[at + 8 : at + 8 + n])
    if bits.read(8) != 0x2F:
        raise ValueError("the signature is wrong")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    opaque = not bits.read(1)
    if bits.read(3):
        raise ValueError("the version is unknown")
    undo, across, kinds = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in kinds:
            raise ValueError("a transform is listed twice")
        kinds.add(kind)
        if kind < 2:
            tile = bits.read(3) + 2
            size = [(v + (1 << tile) - 1) >> tile for v in (height, across)]
            undo.append((kind, tile, _image(bits, size[1], size[0], False).reshape(size), across))
        elif kind == 2:
            undo.append((2, 0, None, across))
        else:
            n = bits.read(8) + 1
            palette = _words(np.cumsum(_bytes(_image(bits, n, 1, False)), axis=0, dtype=np.uint8))
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((3, pack, palette, across))
            across = (across + (1 << pack) - 1) >> pack
    argb = _image(bits, across, height, True).reshape(height, across)
    for kind, tile, table, before in reversed(undo):
        if kind == 0:
            argb = _unpredict(argb, tile, table >> 8 & 255)
        elif kind == 1:
            argb = _uncross(argb, tile, table)
        elif kind == 2:
            green = argb >> 8 & 255
            argb = argb & 0xFF00FF00 | (argb + (green << 16) & 0xFF0000) | ((argb & 255) + green & 255)
        else:
            index = argb >> 8 & 255
            if tile:
                x = np.arange(before)
                index = index[:, x >> tile] >> ((x & ((1 << tile) - 1)) << (3 - tile)).astype(np.uint32) & ((1 << (8 >> tile)) - 1)
            full = np.zeros(256, np.uint32)
            full[: len(table)] = table
            argb = full[index]
    return argb | np.uint32(0xFF000000) if opaque else argb


class Out:
    """Fields to write, the least significant bit first: one by one, or arrays of values and their bits."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.sizes: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def put(self, *fields: tuple[int, int]) -> None:
        for v, n in fields:
            self.values.append(int(v))
            self.sizes.append(int(n))

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.flush()
        self.parts.append((values, sizes))

    def flush(self) -> None:
        if self.values:
            self.parts.append((np.array(self.values, np.int64), np.array(self.sizes, np.int64)))
            self.values, self.sizes = [], []

    def fields(self) -> tuple[np.ndarray, np.ndarray]:
        self.flush()
        return np.concatenate([v for v, _ in self.parts]), np.concatenate([n for _, n in self.parts])

    def bytes(self) -> bytes:
        """Each field is added to the bytes that it touches; their bits don't overlap."""
        values, sizes = self.fields()
        ends = np.cumsum(sizes)
        at = ends - sizes
        values, first = values << (at & 7), at >> 3
        n = int(ends[-1] + 7 >> 3)
        out = np.bincount(first, weights=values & 255, minlength=n + 8)
        for k in range(1, (int(sizes.max()) + 14) >> 3):
            values >>= 8
            if k > 1:  # fields of up to nine bits end before
                some = np.flatnonzero(values)
                first, values = first[some] + 1, values[some]
            else:
                first = first + 1
            if len(first):
                out += np.bincount(first, weights=values & 255, minlength=n + 8)
        return out[:n].astype(np.uint8).tobytes()


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Lengths of a complete prefix code for two or more ``counts``, each at most ``longest``: the logarithms of the shares, rounded up, and shortened until the code is full."""
    total = int(counts.sum())
    counts = np.maximum(counts, -(-total >> longest - 1) or 1)
    total = int(counts.sum())
    sizes = np.ceil(np.log2(total / counts)).astype(np.int64)
    sizes += (counts << sizes) < total
    spare = (1 << longest) - int((1 << (longest - sizes)).sum())
    order = np.lexsort((-counts, sizes)).tolist()
    own = sizes.tolist()
    while spare:
        for k in order:
            unit = 1 << (longest - own[k])
            if unit <= spare and own[k] > 1:
                own[k] -= 1
                spare -= unit
    return np.array(own)


#: Bits that repeats of code lengths carry, by symbol.
_CARRIED = np.array([0] * 16 + [2, 3, 7])


def _put_code(out: Out, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Describes a code for the symbols that occur; gives the bits of each symbol and their number."""
    used = np.flatnonzero(counts)
    values, sizes = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    if not len(used) or len(used) <= 2 and used[-1] < 256:
        first = int(used[0]) if len(used) else 0
        out.put((1, 1), (len(used) > 1, 1), (1, 1), (first, 8))
        if len(used) > 1:
            out.put((int(used[1]), 8))
            values[used[1]] = 1
            sizes[used] = 1
        return values, sizes
    if len(used) == 1:
        counts = counts.copy()
        counts[0] += 1
        used = np.flatnonzero(counts)
    sizes[used] = code_lengths(counts[used], LONGEST)
    order = used[np.argsort(sizes[used], kind="stable")]
    spans = 1 << (LONGEST - sizes[order])
    values[order] = _reversal(LONGEST)[np.cumsum(spans) - spans]  # the first of each symbol's codes of full length
    values &= (1 << sizes) - 1
    ends = np.append(np.flatnonzero(sizes[1:] != sizes[:-1]) + 1, len(sizes))
    tokens: list[int] = []  # symbol, and what it carries times 32
    for size, n in zip(sizes[ends - 1].tolist(), np.diff(ends, prepend=0).tolist()):
        if size:  # the first of them by itself, then repeats of the last length
            tokens.append(size)
            n -= 1
        while n > 2:
            k = min(n, 6 if size else 138)
            tokens.append(16 | k - 3 << 5 if size else 18 | k - 11 << 5 if k > 10 else 17 | k - 3 << 5)
            n -= k
        if n:
            tokens += [size] * n
    listed = np.array(tokens)
    extra, listed = listed >> 5, listed & 31
    seen = np.bincount(listed, minlength=19)
    if np.count_nonzero(seen) == 1:
        seen[0 if not seen[0] else 1] = 1
    kinds = np.flatnonzero(seen)
    own = np.zeros(19, np.int64)
    own[kinds] = code_lengths(seen[kinds], 7)
    known = max(4, 1 + max(k for k, s in enumerate(LENGTH_ORDER) if own[s]))
    out.put((0, 1), (known - 4, 4), *((own[s], 3) for s in LENGTH_ORDER[:known]), (0, 1))
    order = kinds[np.argsort(own[kinds], kind="stable")]
    spans = 1 << (7 - own[order])
    codes = np.zeros(19, np.int64)
    codes[order] = _reversal(7)[np.cumsum(spans) - spans] & ((1 << own[order]) - 1)
    own |= _CARRIED << 8  # a token in one field: its code, then what it carries
    taken = own[listed]
    out.extend(codes[listed] | extra << (taken & 255), (taken & 255) + (taken >> 8))
    return values, sizes


def _prefixes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of lengths or distances, their further bits and the number of those."""
    less = v - 1
    k = np.maximum(np.frexp(less)[1] - 2, 0)  # bits after the first two
    return np.where(v <= 4, less, 2 * k + 2 + (less >> k & 1)), np.where(v <= 4, 0, less & ((1 << k) - 1)), np.where(v <= 4, 0, k)


def _references(data: bytes) -> np.ndarray:
    """Rows of place, length and distance: ``REPEAT`` or more bytes that stood somewhere before; taken as they come."""
    n = len(data)
    if n <= REPEAT:
        return np.zeros((0, 3), np.int64)
    keys = np.ndarray((n - REPEAT + 1,), f"<u{REPEAT}", data, 0, (1,)).copy()  # the bytes from each place on as a number
    short = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16)
    order = np.argsort(short, kind="stable")  # the last place before each of the same hash, where the bytes are the same too
    sorted_keys = keys[order]
    same = sorted_keys[1:] == sorted_keys[:-1]
    at = order[1:][same]
    sort = np.argsort(at)
    starts, earlier = at[sort].tolist(), order[:-1][same][sort].tolist()
    out, done, next_one = [], 0, 0
    while (next_one := bisect_left(starts, done, next_one)) < len(starts):
        i, j = starts[next_one], earlier[next_one]
        length = step = REPEAT
        while length + step <= 4096 and i + length + step <= n and data[i + length : i + length + step] == data[j + length : j + length + step]:
            length += step
            step = min(2 * step, 1024)
        while step := step // 2:
            if length + step <= 4096 and i + length + step <= n and data[i + length : i + length + step] == data[j + length : j + length + step]:
                length += step
        done = i + length
        out.append((i, length, i - j))
    return np.array(out, np.int64).reshape(-1, 3)


@cache
def _near(width: int) -> np.ndarray:
    """Codes of distances in an image of that width, as far as the short ones reach."""
    out = np.arange(8 * width + 9) + 120
    for k in range(len(NEAR) - 1, -1, -1):
        x, y = NEAR[k]
        out[max(1, x + y * width)] = k + 1
    return out


@cache
def _slots(alpha: int) -> np.ndarray:
    """Cache slot of each green value beside that alpha and no red and blue."""
    return ((np.arange(256, dtype=np.uint32) << np.uint32(8) | np.uint32(alpha << 24)) * np.uint32(HASH) >> np.uint32(32 - CACHE)).astype(np.uint8)


@lru_cache(4096)
def _literals(words: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """A small image of ARGB words, pixel by pixel, as fields."""
    out, v = Out(), np.array(words, np.uint32)
    out.put((0, 1))
    channels = [v >> np.uint32(k) & np.uint32(255) for k in (8, 16, 0, 24)]
    codes = [_put_code(out, np.bincount(c, minlength=n)) for c, n in zip(channels, (280, 256, 256, 256))]
    _put_code(out, np.zeros(40, np.int64))
    out.extend(np.stack([c[x] for (c, _), x in zip(codes, channels)], 1).ravel(), np.stack([n[x] for (_, n), x in zip(codes, channels)], 1).ravel())
    return out.fields()


def _put_literals(out: Out, v: np.ndarray) -> None:
    out.extend(*_literals(tuple(v.tolist())))


def _put_green(out: Out, green: np.ndarray, alpha: int, width: int, odd: dict[int, int]) -> None:
    """The main image: pixels of ``green``, no red and blue, and ``alpha``, but for the places in ``odd``."""
    found = _references(b"" if odd else green.tobytes())
    first, ends = found[:, 0], found[:, 0] + found[:, 1]
    edges = np.zeros(len(green) + 1, np.int64)
    edges[first] += 1
    edges[ends] -= 1
    literal = np.cumsum(edges[:-1]) == 0
    slots = _slots(alpha)[green]
    before = np.full(len(green), -1)
    for k in range(1 << CACHE):
        own = np.flatnonzero(slots == k)
        before[own[1:]] = own[:-1]
    hits = literal & (before >= 0) & (green == green[before])
    bits = CACHE if hits.any() and not odd else 0
    if not bits:
        hits[:] = False
    out.put((bits > 0, 1), *([(bits, 4)] if bits else []), (0, 1))
    symbols = green.astype(np.int64)
    symbols[hits] = 280 + slots[hits].astype(np.int64)
    length_symbols, more, more_bits = _prefixes(found[:, 1])
    near = _near(width)
    codes = found[:, 2] + 120
    close = found[:, 2] < len(near)
    codes[close] = near[found[close, 2]]
    far_symbols, beyond, beyond_bits = _prefixes(codes)
    literal[first] = True
    symbols[first] = 256 + length_symbols
    places = np.flatnonzero(literal)
    symbols = symbols[places]
    number = np.searchsorted(places, first)
    code = _put_code(out, np.bincount(symbols, minlength=280 + (1 << bits if bits else 0)))
    out.put(*2 * [(1, 1), (0, 1), (1, 1), (0, 8)])  # red and blue are 0
    if odd:
        alphas = np.full(len(places), alpha)
        for i, v in odd.items():
            alphas[i] = v
        see = _put_code(out, np.bincount(alphas[symbols < 256], minlength=256))
    else:
        out.put((1, 1), (0, 1), (1, 1), (alpha, 8))
    far = _put_code(out, np.bincount(far_symbols, minlength=40))
    if not odd:  # red, blue and alpha take no bits: a field a literal, two a reference
        values, sizes = code[0][symbols], code[1][symbols]
        if len(found):
            values[number] |= more << sizes[number]
            sizes[number] += more_bits
            after = far[1][far_symbols]
            values = np.insert(values, number + 1, far[0][far_symbols] | beyond << after)
            sizes = np.insert(sizes, number + 1, after + beyond_bits)
        out.extend(values, sizes)
        return
    values, sizes = np.zeros((len(places), 2), np.int64), np.zeros((len(places), 2), np.int64)  # no references then
    values[:, 0], sizes[:, 0] = code[0][symbols], code[1][symbols]
    values[:, 1], sizes[:, 1] = see[0][alphas], see[1][alphas]
    out.extend(values.ravel(), sizes.ravel())


def _bits_of(rest: np.ndarray) -> float:
    counts = np.bincount(rest, minlength=256)
    counts = counts[counts > 0]
    return float(len(rest) * np.log2(len(rest)) - (counts * np.log2(counts)).sum())


def _predict(v: np.ndarray, width: int, first: int) -> tuple[list[int], np.ndarray]:
    """A mode for each tile (the image is one tile wide), and what the guesses leave of ``v``; ``first``: the guess of the first pixel."""
    rest = np.empty_like(v)
    rest[0] = v[0] - np.uint8(first)
    rest[1:width] = v[1:width] - v[: width - 1]
    modes, side = [], width << TILE
    for start in range(0, len(v), side):
        end = min(len(v), start + side)
        low = max(start, width)
        if low >= end:
            modes.append(1)
            continue
        top, top_left = v[low - width : end - width], v[low - width - 1 : end - width - 1] if low > width else np.concatenate([v[:1], v[: end - width - 1]])
        top_right = v[low - width + 1 : end - width + 1]
        own = v[low:end]
        left = own - v[low - 1 : end - 1]
        best, mode, least = left, 1, _bits_of(left) * (1 - GAIN)
        for m in MODES[1:]:
            other = own - _above(m, top, top_left, top_right)
            if (bits := _bits_of(other)) < least:
                best, mode, least = other, m, bits
        modes.append(mode)
        rest[low:end] = best
    rest[width::width] = v[width::width] - v[:-width:width]
    return modes, rest


def encode(payload: bytes) -> bytes:
    """A lossless WebP file of ``payload`` (not empty): ``ROW`` pixels a row, or twice as many and so on if there would be over ``SIDE`` rows."""
    n, width = len(payload), ROW
    while n > width * SIDE and 2 * width <= SIDE:
        width *= 2
    height = -(-n // width)
    spare = width * height - n
    v = np.frombuffer(payload + bytes(spare), np.uint8)
    out = Out()
    out.put((0x2F, 8), (width - 1, 14), (height - 1, 14), (spare > 0, 1), (0, 3))
    colours = np.flatnonzero(np.bincount(v, minlength=256)) if not spare else np.arange(256)
    if len(colours) <= FEW:
        out.put((1, 1), (3, 2), (len(colours) - 1, 8))
        steps = np.diff(colours, prepend=0).astype(np.uint32)
        words = steps * np.uint32(0x010101)
        words[0] |= np.uint32(0xFF000000)
        _put_literals(out, words)
        pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1
        index = np.searchsorted(colours, v).astype(np.uint8).reshape(height, width >> pack, 1 << pack)
        index = (index << (np.arange(1 << pack, dtype=np.uint8) * np.uint8(8 >> pack))).sum(axis=2, dtype=np.uint8)
        out.put((0, 1))
        _put_green(out, index.ravel(), 255, width >> pack, {})
    else:
        # a row is at most ``SIDE`` pixels wide, so several tiles; all of a row of tiles share a mode
        modes, rest = _predict(v, width, 0)
        across = width + (1 << TILE) - 1 >> TILE
        out.put((1, 1), (0, 2), (TILE - 2, 3))
        _put_literals(out, np.repeat(np.array(modes, np.uint32) << np.uint32(8), across))
        out.put((1, 1), (1, 2), (TILE - 2, 3))
        _put_literals(out, np.full(len(modes) * across, 32 << 8 | 32, np.uint32))  # 32: all of green
        out.put((0, 1))
        odd = {}
        if spare:
            shown = np.full(len(v), 255, np.uint8)
            shown[n:] = 0
            faint = _guessed(shown, modes, width)
            odd = {int(i): int(faint[i]) for i in np.flatnonzero(faint)}
        _put_green(out, rest, 0, width, odd)
    body = out.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + bytes(len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def _guessed(v: np.ndarray, modes: list[int], width: int) -> np.ndarray:
    """What the modes that were chosen leave of another channel, whose first guess is 255."""
    rest = v - np.concatenate([[np.uint8(255)], v[:-1]])
    if len(v) > width:
        top, top_left = v[:-width], np.concatenate([v[:1], v[: -width - 1]])
        top_right = v[1 : len(v) - width + 1]
        for k, m in enumerate(modes):
            low, end = max(width, k * width << TILE), min(len(v), (k + 1) * width << TILE)
            if m != 1 and low < end:
                at = slice(low - width, end - width)
                rest[low:end] = v[low:end] - _above(m, top[at], top_left[at], top_right[at])
        rest[width::width] = v[width::width] - v[:-width:width]
    return rest


def samples(argb: np.ndarray) -> bytes:
    """Green of the opaque pixels: what ``encode`` was given."""
    flat = argb.ravel()
    kept = flat if (flat >= 0xFF000000).all() else flat[flat >= 0xFF000000]
    return (kept >> np.uint32(8)).astype(np.uint8).tobytes()


def pad(text: bytes) -> bytes:
    """Spaces up to a positive multiple of 192."""
    return text + b" " * (max(1, -(-len(text) // 192)) * 192 - len(text))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: whole texts, padded by ``pad``, as lossless WebP.

    Null texts count as empty; repeated rows and rows without an id get a row each, equal texts equal files; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t.as_py() or b"" for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array([encode(pad(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def pixels(media: DataFrame, media_col: str = "media") -> DataFrame:
    """The columns of ``media`` and ``width, height, argb`` (big-endian words, row by row), or ``error`` where a file can't be decoded (null: no media)."""
    kept = [c for c in media.columns if c not in ("width", "height", "argb", "error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for m in part.column(part.schema.get_field_index(media_col)):
                    try:
                        image = decode(m.as_py()) if m.as_py() is not None else None
                        rows.append((None, None, None, "no media") if image is None else (image.shape[1], image.shape[0], image.astype(">u4").tobytes(), None))
                    except (ValueError, IndexError) as e:
                        rows.append((None, None, None, str(e)))
                extra = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in kept] + extra, [*kept, "width", "height", "argb", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name in kept)
    return media.mapInArrow(run, f"{schema}, width int, height int, argb binary, error string")


def digests(images: DataFrame) -> DataFrame:
    """Of ``pixels``'s rows over ``store``'s, from the pixel arrays: sizes, SHA-256 of payload and file, CRC-32 of the last 16 payload bytes, and a feature.

    The feature: size in pixels, mean sample to three places, and the number of distinct samples. Rows without pixels (null or
    damaged media) have nulls there; repeated rows get a row each; an empty table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            rows = []
            for i, n, m, width, height, words in zip(*batch.columns):
                if not words.is_valid:
                    rows.append((i.as_py(), n.as_py(), None, None, None, None, None, None))
                    continue
                image, file = np.frombuffer(words.as_buffer(), np.uint8).reshape(-1, 4), m.as_buffer()
                shown = image[:, 0] == 255
                green = image[:, 2] if shown.all() else image[shown, 2]  # as ``samples``, from big-endian words
                payload = green.tobytes()
                counts = np.bincount(green, minlength=256)
                feature = f"{width}x{height}:{int(counts @ _places(256)) / max(1, len(payload)):.3f}:{np.count_nonzero(counts)}"
                rows.append((i.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), file.size, hashlib.sha256(file).hexdigest(), feature))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    own = images.select("doc_id", "n_bytes", "media", "width", "height", "argb")
    return own.mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
