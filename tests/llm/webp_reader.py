"""Reads VP8L streams bit by bit and pixel by pixel, as the format's description says, for comparison with the operator's decoder."""

import struct

from sylva.llm import webp


class Reader:
    def __init__(self, data):
        self.data, self.at = data, 0

    def bit(self):
        if self.at >= 8 * len(self.data):
            raise ValueError("end")
        b = self.data[self.at >> 3] >> (self.at & 7) & 1
        self.at += 1
        return b

    def read(self, n):
        return sum(self.bit() << k for k in range(n))


def canonical(lengths):
    """{(length, code): symbol}, or the only symbol."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) < 2:
        return used[0] if used else 0
    out, code = {}, 0
    for n in range(1, 16):
        for s in used:
            if lengths[s] == n:
                out[n, code] = s
                code += 1
        code <<= 1
    return out


def symbol(r, code):
    if isinstance(code, int):
        return code
    n = v = 0
    while (n, v) not in code:
        v, n = v << 1 | r.bit(), n + 1
    return code[n, v]


def read_code(r, size):
    lengths = [0] * size
    if r.bit():
        n = r.bit() + 1
        lengths[r.read(8 if r.bit() else 1)] = 1
        if n == 2:
            lengths[r.read(8)] = 1
        return canonical(lengths)
    own = [0] * 19
    for k in range(4 + r.read(4)):
        own[webp.LENGTH_ORDER[k]] = r.read(3)
    code, most = canonical(own), size
    if r.bit():
        most = 2 + r.read(2 + 2 * r.read(3))
    k, before = 0, 8
    while k < size and most:
        most -= 1
        s = symbol(r, code)
        if s < 16:
            lengths[k] = s
            before = s or before
            k += 1
        else:
            n, v = (3 + r.read(2), before) if s == 16 else (3 + r.read(3), 0) if s == 17 else (11 + r.read(7), 0)
            for _ in range(n):
                lengths[k] = v
                k += 1
    return canonical(lengths)


def number(r, p):
    if p < 4:
        return p + 1
    n = (p - 2) >> 1
    return ((2 + (p & 1)) << n) + r.read(n) + 1


def read_image(r, width, height, main, seen=None):
    bits = r.read(4) if r.bit() else 0
    if main:
        assert not r.bit()
    sizes = (280 + (1 << bits if bits else 0), 256, 256, 256, 40)
    green, red, blue, alpha, far = (read_code(r, n) for n in sizes)
    out, cache = [], [0] * (1 << bits)

    def add(v):
        out.append(v)
        if bits:
            cache[(0x1E35A7BD * v & 0xFFFFFFFF) >> (32 - bits)] = v

    while len(out) < width * height:
        s = symbol(r, green)
        if s < 256:
            rd, bl, al = symbol(r, red), symbol(r, blue), symbol(r, alpha)
            add(al << 24 | rd << 16 | s << 8 | bl)
        elif s < 280:
            n = number(r, s - 256)
            d = number(r, symbol(r, far))
            if d > 120:
                d -= 120
            else:
                x, y = webp.NEAR[d - 1]
                d = max(1, x + y * width)
            for _ in range(n):
                add(out[-d])
            if seen is not None:
                seen.add("reference")
        else:
            add(cache[s - 280])
            if seen is not None:
                seen.add("cache")
    if seen is not None and isinstance(green, dict) and len({n for n, _ in green}) > 1:
        seen.add("lengths")
    return out


def parts(v):
    return [v >> k & 255 for k in (24, 16, 8, 0)]


def joined(c):
    return sum((x & 255) << k for x, k in zip(c, (24, 16, 8, 0)))


def guess(mode, left, top, tl, tr):
    avg = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clamp = lambda x: min(255, max(0, x))
    if mode == 11:
        pa = [a + b - c for a, b, c in zip(left, top, tl)]
        return left if sum(abs(p - x) for p, x in zip(pa, left)) < sum(abs(p - x) for p, x in zip(pa, top)) else top
    if mode == 12:
        return [clamp(a + b - c) for a, b, c in zip(left, top, tl)]
    if mode == 13:
        return [clamp(a + int((a - b) / 2)) for a, b in zip(avg(left, top), tl)]
    table = {0: [255, 0, 0, 0], 1: left, 2: top, 3: tr, 4: tl, 5: avg(avg(left, tr), top), 6: avg(left, tl), 7: avg(left, top), 8: avg(tl, top), 9: avg(top, tr), 10: avg(avg(left, tl), avg(top, tr))}
    return table.get(mode, [255, 0, 0, 0])


def read(file, seen=None):
    """Rows of ARGB words; ``seen`` gathers the features that the stream uses."""
    assert file[:4] == b"RIFF" and file[8:16] == b"WEBPVP8L"
    r = Reader(file[20 : 20 + struct.unpack("<I", file[16:20])[0]])
    assert r.read(8) == 0x2F
    width, height = r.read(14) + 1, r.read(14) + 1
    shown = r.bit()
    assert r.read(3) == 0
    undo, across = [], width
    while r.bit():
        kind = r.read(2)
        if kind < 2:
            tile = r.read(3) + 2
            w, h = -(-across // (1 << tile)), -(-height // (1 << tile))
            undo.append((kind, tile, read_image(r, w, h, False), across, w))
        elif kind == 2:
            undo.append((2, 0, None, across, 0))
        else:
            n = r.read(8) + 1
            colours, last = [], [0, 0, 0, 0]
            for v in read_image(r, n, 1, False):
                last = [(a + b) & 255 for a, b in zip(last, parts(v))]
                colours.append(joined(last))
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((3, pack, colours, across, 0))
            across = -(-across // (1 << pack))
        if seen is not None:
            seen.add(("predictor", "cross", "green", "palette")[kind])
            if kind == 0:
                seen |= {f"mode {v >> 8 & 255}" for v in undo[-1][2]}
    px = read_image(r, across, height, True, seen)
    signed = lambda v: v - 256 if v > 127 else v
    for kind, tile, table, before, w in reversed(undo):
        if kind == 0:
            out = []
            for i, v in enumerate(px):
                y, x = divmod(i, before)
                if i == 0:
                    p = [255, 0, 0, 0]
                elif y == 0:
                    p = parts(out[i - 1])
                elif x == 0:
                    p = parts(out[i - before])
                else:
                    p = guess(table[(y >> tile) * w + (x >> tile)] >> 8 & 255, parts(out[i - 1]), parts(out[i - before]), parts(out[i - before - 1]), parts(out[i - before + 1]))
                out.append(joined([a + b for a, b in zip(parts(v), p)]))
            px = out
        elif kind == 1:
            out = []
            for i, v in enumerate(px):
                y, x = divmod(i, before)
                _, rb, gb, gr = parts(table[(y >> tile) * w + (x >> tile)])
                a, rd, g, b = parts(v)
                rd = rd + (signed(gr) * signed(g) >> 5) & 255
                b = b + (signed(gb) * signed(g) >> 5) + (signed(rb) * signed(rd) >> 5) & 255
                out.append(joined([a, rd, g, b]))
            px = out
        elif kind == 2:
            px = [joined([a, rd + g, g, b + g]) for a, rd, g, b in map(parts, px)]
        else:
            size, rows = 8 >> tile, [px[k : k + -(-before // (1 << tile))] for k in range(0, len(px), -(-before // (1 << tile)))]
            at = lambda row, x: (row[x >> tile] >> 8 & 255) >> ((x & ((1 << tile) - 1)) * size) & ((1 << size) - 1) if tile else row[x] >> 8 & 255
            px = [table[k] if (k := at(row, x)) < len(table) else 0 for row in rows for x in range(before)]
    if not shown:
        px = [v | 0xFF000000 for v in px]
    return [px[k : k + width] for k in range(0, len(px), width)]
