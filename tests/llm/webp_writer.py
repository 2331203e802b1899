"""Writes VP8L streams with any mix of features, symbol by symbol, for the decoder's tests."""

import heapq
import struct

import numpy as np

from sylva.llm import webp


class Out:
    def __init__(self):
        self.bits = []

    def put(self, v, n):
        self.bits += [v >> k & 1 for k in range(n)]

    def bytes(self):
        return np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()


def lengths_of(counts, most):
    """Huffman code lengths of at most ``most`` bits."""
    while True:
        heap = [(c, k, (s,)) for k, (s, c) in enumerate(sorted(counts.items()))]
        heapq.heapify(heap)
        out = dict.fromkeys(counts, 0)
        n = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                out[s] += 1
            heapq.heappush(heap, (a[0] + b[0], n, a[2] + b[2]))
            n += 1
        if max(out.values()) <= most:
            return out
        counts = {s: (c + 1) // 2 for s, c in counts.items()}


def codes_of(lengths):
    code, last, out = 0, 0, {}
    for n, s in sorted((n, s) for s, n in lengths.items() if n):
        code <<= n - last
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code, last = code + 1, n
    return out


def put_code(out, counts, size):
    """Describes a code for the symbols of ``counts``; gives (bits, length) by symbol."""
    used = sorted(counts)
    if len(used) <= 1 and (not used or used[0] < 256):
        s = used[0] if used else 0
        out.put(1, 1), out.put(0, 1), out.put(int(s > 1), 1), out.put(s, 8 if s > 1 else 1)
        return {s: (0, 0)}
    if len(used) == 2 and used[1] < 256:
        out.put(1, 1), out.put(1, 1), out.put(1, 1), out.put(used[0], 8), out.put(used[1], 8)
        return {used[0]: (0, 1), used[1]: (1, 1)}
    if len(used) == 1:
        counts = counts | {0: 1}
    lengths = lengths_of(counts, 15)
    row = [lengths.get(s, 0) for s in range(max(lengths) + 1)]
    tokens, k = [], 0
    while k < len(row):
        run = 1
        while k + run < len(row) and row[k + run] == row[k]:
            run += 1
        if row[k] == 0 and run >= 11:
            run = min(run, 138)
            tokens.append((18, run - 11, 7))
        elif row[k] == 0 and run >= 3:
            tokens.append((17, run - 3, 3))
        elif row[k] and run >= 4:
            run = min(run, 7)
            tokens += [(row[k], 0, 0), (16, run - 4, 2)]
        else:
            run = 1
            tokens.append((row[k], 0, 0))
        k += run
    seen = {}
    for t, _, _ in tokens:
        seen[t] = seen.get(t, 0) + 1
    own = lengths_of(seen if len(seen) > 1 else seen | {(17 if 17 not in seen else 0): 1}, 7)
    out.put(0, 1)
    order = max(k for k, s in enumerate(webp.LENGTH_ORDER) if own.get(s)) + 1
    out.put(max(4, order) - 4, 4)
    for s in webp.LENGTH_ORDER[: max(4, order)]:
        out.put(own.get(s, 0), 3)
    short = len(row) < size
    out.put(int(short), 1)
    if short:
        n = max(2, len(tokens))
        tokens += [(0, 0, 0)] * (n - len(tokens)) if 0 in own else []
        out.put(4, 3), out.put(len(tokens) - 2, 10)
    coded = codes_of(own)
    for t, v, n in tokens:
        out.put(*coded[t]), out.put(v, n)
    return codes_of(lengths)


def prefix(v):
    """Prefix symbol, extra bits and their number of a length or distance."""
    if v <= 4:
        return v - 1, 0, 0
    v -= 1
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, v - ((2 + second) << (top - 1)), top - 1


def put_image(out, argb, width, main, cache_bits=0, matches=False, tile=0):
    argb = [int(v) for v in argb]
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    of = None
    height = len(argb) // width
    if main:
        out.put(int(tile > 0), 1)
        if tile:
            out.put(tile - 2, 3)
            across, down = -(-width // (1 << tile)), -(-height // (1 << tile))
            of = [(x + y) % 2 for y in range(down) for x in range(across)]
            put_image(out, [v << 8 for v in of], across, False)
    group = lambda at: of[(at // width >> tile) * across + (at % width >> tile)] if of else 0
    ops, at, cache, last = [], 0, [0] * (1 << cache_bits), {}
    while at < len(argb):
        start = last.get(tuple(argb[at : at + 3])) if matches else None
        n = 0
        if start is not None:
            while at + n < len(argb) and n < 4096 and argb[start + n] == argb[at + n]:
                n += 1
        slot = (webp.HASH * argb[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if n >= 3:
            d = at - start
            near = next((k + 1 for k, (x, y) in enumerate(webp.NEAR) if x + y * width == d), None)
            ops.append((group(at), "m", prefix(n), prefix(near or d + 120)))
        elif cache_bits and cache[slot] == argb[at]:
            n = 1
            ops.append((group(at), "c", 280 + slot))
        else:
            n = 1
            ops.append((group(at), "l", argb[at]))
        for k in range(at, at + n):
            last.setdefault(tuple(argb[k : k + 3]), k)
            if cache_bits:
                cache[(webp.HASH * argb[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = argb[k]
        at += n
    groups = max(of) + 1 if of else 1
    counts = [[{} for _ in range(5)] for _ in range(groups)]

    def add(g, which, s):
        counts[g][which][s] = counts[g][which].get(s, 0) + 1

    for g, kind, *x in ops:
        if kind == "l":
            for which, k in ((0, 8), (1, 16), (2, 0), (3, 24)):
                add(g, which, x[0] >> k & 255)
        elif kind == "c":
            add(g, 0, x[0])
        else:
            add(g, 0, 256 + x[0][0]), add(g, 4, x[1][0])
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[put_code(out, c, n) for c, n in zip(own, sizes)] for own in counts]
    for g, kind, *x in ops:
        if kind == "l":
            for which, k in ((0, 8), (1, 16), (2, 0), (3, 24)):
                out.put(*codes[g][which][x[0] >> k & 255])
        elif kind == "c":
            out.put(*codes[g][0][x[0]])
        else:
            out.put(*codes[g][0][256 + x[0][0]]), out.put(*x[0][1:]), out.put(*codes[g][4][x[1][0]]), out.put(*x[1][1:])


def channels(v):
    return np.array([int(v) >> k & 255 for k in (24, 16, 8, 0)])


def pack(c):
    a, r, g, b = (int(x) & 255 for x in c)
    return a << 24 | r << 16 | g << 8 | b


def write(argb, predict=None, cross=None, green=False, palette=False, tile_bits=2, alpha=True, **image):
    """``argb``: uint32[height, width]. ``predict``: a mode by tile index; ``cross``: factor words likewise."""
    height, width = argb.shape
    out = Out()
    out.put(0x2F, 8), out.put(width - 1, 14), out.put(height - 1, 14), out.put(int(alpha), 1), out.put(0, 3)
    rows, across = [[int(v) for v in row] for row in argb], width
    if palette:
        colours = sorted({v for row in rows for v in row})
        out.put(1, 1), out.put(3, 2), out.put(len(colours) - 1, 8)
        deltas = [colours[0]] + [pack(channels(b) - channels(a)) for a, b in zip(colours, colours[1:])]
        put_image(out, deltas, len(colours), False)
        bits = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        per, size = 1 << bits, 8 >> bits
        across = -(-width // per)
        at = {v: k for k, v in enumerate(colours)}
        rows = [[0xFF000000 | sum(at[v] << (k * size) for k, v in enumerate(row[x : x + per])) << 8 for x in range(0, width, per)] for row in rows]
    if green:
        out.put(1, 1), out.put(2, 2)
        rows = [[pack((c := channels(v)) - np.array([0, c[2], 0, c[2]])) for v in row] for row in rows]
    tiles = (-(-height // (1 << tile_bits)), -(-across // (1 << tile_bits)))
    if cross:
        words = [cross(k) for k in range(tiles[0] * tiles[1])]
        out.put(1, 1), out.put(1, 2), out.put(tile_bits - 2, 3)
        put_image(out, words, tiles[1], False)
        signed = lambda v: v - 256 if v > 127 else v
        for y, row in enumerate(rows):
            for x, v in enumerate(row):
                f, (a, r, g, b) = words[(y >> tile_bits) * tiles[1] + (x >> tile_bits)], map(int, channels(v))
                d = lambda t, c: signed(t & 255) * signed(c) >> 5
                row[x] = pack((a, r - d(f, g), g, b - d(f >> 8, g) - d(f >> 16, r)))
    if predict:
        modes = [predict(k) for k in range(tiles[0] * tiles[1])]
        out.put(1, 1), out.put(0, 2), out.put(tile_bits - 2, 3)
        put_image(out, [m << 8 for m in modes], tiles[1], False)
        flat = [channels(v) for row in rows for v in row]
        rest = []
        for at, c in enumerate(flat):
            y, x = divmod(at, across)
            if not y:
                p = flat[at - 1] if x else np.array([255, 0, 0, 0])
            elif not x:
                p = flat[at - across]
            else:
                p = webp.predicted(modes[(y >> tile_bits) * tiles[1] + (x >> tile_bits)], flat[at - 1], flat[at - across], flat[at - across - 1], flat[at - across + 1])
            rest.append(pack(c - p))
        rows = [rest[k : k + across] for k in range(0, len(rest), across)]
    out.put(0, 1)
    put_image(out, [v for row in rows for v in row], across, True, **image)
    body = out.bytes()
    chunk = b"ALPH" + struct.pack("<I", 3) + b"abc\0" + b"VP8L" + struct.pack("<I", len(body)) + body + bytes(len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
