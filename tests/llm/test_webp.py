import hashlib
import zlib

import numpy as np
import pytest

from sylva.llm import webp

from .webp_reader import read
from .webp_writer import write


def picture(height, width, colours=0, seed=1):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:height, :width]
    base = np.stack([255 - (x // 9), x * 3 + y, y * 5 + x // 3, (x * y) // 7], -1) + rng.integers(0, 4, (height, width, 4))
    c = (base & 255).astype(np.uint32)
    argb = c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]
    return rng.choice(argb.ravel()[:colours], (height, width)).astype(np.uint32) if colours else argb


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    image = picture(9, 14)
    assert (webp.decode(write(image, predict=lambda k: mode)) == image).all()


@pytest.mark.parametrize(
    "features",
    [
        {}, {"cache_bits": 4}, {"cache_bits": 11}, {"matches": True}, {"matches": True, "cache_bits": 6}, {"tile": 2, "matches": True}, {"green": True}, {"cross": lambda k: 0xFF000000 | (k * 77 & 0xFFFFFF)},
        {"predict": lambda k: k % 14, "cross": lambda k: 0xFF102030 + k, "green": True, "matches": True, "cache_bits": 3, "tile": 3},
    ],
)
def test_features(features):
    for image in (picture(13, 21), picture(12, 19, 40), picture(1, 1), picture(1, 33, 2), picture(40, 3, 5)):
        assert (webp.decode(write(image, **features)) == image).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 7, 16, 17, 200])
def test_palette(colours):
    image = picture(11, 23, colours)
    assert (webp.decode(write(image, palette=True, matches=True)) == image).all()
    assert (webp.decode(write(image, palette=True, predict=lambda k: 11, cache_bits=5)) == image).all()


def test_opaque_images_have_alpha_255():
    image = picture(5, 6)
    assert (webp.decode(write(image, alpha=False)) == image | 0xFF000000).all()


def test_damaged_files_are_errors():
    file = write(picture(9, 9), matches=True, cache_bits=3)
    for cut in (0, 3, 11, 20, 30, len(file) // 2):
        with pytest.raises(ValueError):
            webp.decode(file[:cut])
    with pytest.raises(ValueError):
        webp.decode(file.replace(b"VP8L", b"VP8 "))


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 40_000])
@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abc", b"abcdefghij ", bytes(range(256))])
def test_payload_round_trip(size, alphabet):
    rng = np.random.default_rng(size)
    payload = webp.pad(bytes(rng.choice(list(alphabet), size).astype(np.uint8)))
    assert len(payload) % 192 == 0 and len(payload) > size - 1
    assert webp.samples(webp.decode(webp.encode(payload))) == payload


@pytest.mark.parametrize("row, side", [(4, 32), (5, 40), (7, 14), (192, 16384)])
def test_rows_beyond_the_format_widen_the_image(monkeypatch, row, side):
    monkeypatch.setattr(webp, "ROW", row)
    monkeypatch.setattr(webp, "SIDE", side)
    for payload in (webp.pad(b"The quick brown fox, 0123456789 times."), webp.pad(b"ab")):
        file = webp.encode(payload)
        image = webp.decode(file)
        assert image.shape[1] % row == 0 and webp.samples(image) == payload
        assert read(file) == image.tolist()


def texts():
    rng = np.random.default_rng(9)
    prose = " ".join(rng.choice(["the", "onerous", "Lion", "hath,", "é", "12", "x.\n"], 700))
    noise = rng.integers(0, 256, 3000).astype(np.uint8).tobytes()
    rows = bytes(range(192)) * 9 + bytes(rng.integers(0, 3, 192).astype(np.uint8))
    ramp = bytes(i * 7 + j & 255 for i in range(30) for j in range(192))
    return {"prose": prose.encode(), "noise": noise, "rows": rows, "ramp": ramp, "two": b"ab" * 300, "one": b"", "few": b"0123456789abcdef" * 40, "again": prose.encode() * 3, "hash": hashlib.sha256(noise).hexdigest().encode() * 9}


@pytest.mark.parametrize("stretch", [64, webp.STRETCH])
def test_streams_against_a_plain_reader(monkeypatch, stretch):
    monkeypatch.setattr(webp, "STRETCH", stretch)
    every = set()
    for name, text in texts().items():
        payload, seen = webp.pad(text), set()
        file = webp.encode(payload)
        image = webp.decode(file)
        assert read(file, seen) == image.tolist(), name
        assert webp.samples(image) == payload and image.size == len(payload)
        every |= seen
        if name in ("prose", "again", "ramp", "rows"):
            assert {"predictor", "cross", "lengths"} <= seen, name
    assert {"predictor", "cross", "palette", "lengths", "reference", "cache", "mode 1", "mode 2"} <= every


@pytest.mark.parametrize("features", [{"matches": True, "cache_bits": 6}, {"predict": lambda k: k % 14, "cross": lambda k: 0xFF102030 + k, "green": True, "matches": True}])
def test_other_streams_against_a_plain_reader(features):
    for image in (picture(13, 21), picture(12, 19, 40)):
        file = write(image, **features)
        file = file[:12] + file[24:]  # the plain reader knows no other chunks
        assert read(file) == webp.decode(file).tolist() == image.tolist()


def test_code_lengths_fill_the_code():
    rng = np.random.default_rng(4)
    for longest, most in ((7, 19), (webp.LONGEST, 536)):
        for _ in range(400):
            counts = rng.integers(1, rng.choice([2, 9, 100_000]), rng.integers(2, most))
            counts[0] = 10 ** rng.integers(0, 7)
            sizes = webp.code_lengths(counts, longest)
            assert (1 << longest - sizes).sum() == 1 << longest and 1 <= sizes.min() and sizes.max() <= longest


def test_query_columns(spark):
    own = [None, "", "a", "é" * 500, "x" * 200_000, "same", "same", "The prose, that is coded. " * 40]
    rows = [(i, t, "clash", 5) for i, t in enumerate(own)] + [(None, "null id", "", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, media string, width int")
    got = {r.doc_id: r for r in webp.digests(webp.pixels(webp.store(frame))).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        raw = (t or "").encode()
        payload = webp.pad(raw)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        file = webp.encode(payload)
        assert (got[i].media_sha256, got[i].media_bytes) == (hashlib.sha256(file).hexdigest(), len(file))
    assert tuple(got[5])[1:] == tuple(got[6])[1:]
    assert webp.digests(webp.pixels(webp.store(frame.limit(0)))).collect() == []


def test_digests_without_media(spark):
    frame = spark.createDataFrame([(1, 5, None, "x"), (2, 6, bytearray(b"no"), "y")], "doc_id long, n_bytes long, media binary, error string")
    got = webp.digests(webp.pixels(frame)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, 5, *[None] * 6), (2, 6, *[None] * 6)]


def test_pixel_arrays(spark):
    image = picture(4, 5)
    frame = spark.createDataFrame([(1, bytearray(write(image, matches=True)), 9), (2, bytearray(b"no"), 9), (3, None, 9)], "id int, media binary, width int")
    good, bad, none = webp.pixels(frame).orderBy("id").collect()
    assert (np.frombuffer(bytes(good.argb), ">u4").reshape(good.height, good.width) == image).all() and good.error is None
    assert bad.argb is None and bad.error and none.error == "no media"


def test_short_codes_are_those_of_any_length_and_must_be_full():
    rng = np.random.default_rng(4)
    full = 0
    for _ in range(2_000):
        lengths = rng.choice(8, 19, p=[0.5, 0.05, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05]).tolist() if rng.random() < 0.5 else webp.code_lengths(rng.integers(1, 50, 19), 7).tolist()
        try:
            want = webp.Code(lengths)
        except ValueError:
            with pytest.raises(ValueError):
                webp.Code.short(lengths)
            continue
        got = webp.Code.short(lengths)
        full += 1
        assert (got.width, got.table) == (want.width, want.table)
    assert full > 500
    with pytest.raises(ValueError):
        webp.Code.short([1, 1, 1])


def test_symbols_are_followed_several_at_a_time(monkeypatch):
    """A text of some thousand literals takes hundreds of looks, not one a symbol; a stretch that ends within a reference goes on behind it."""
    looks = []

    class Looked:
        def __init__(self, of):
            self.of = of

        def __getitem__(self, p):
            looks.append(p)
            return self.of[p]

    monkeypatch.setitem(vars(webp), "memoryview", lambda a: Looked(memoryview(a)) if a.dtype == np.int64 else memoryview(a))
    words = np.random.default_rng(2).integers(97, 123, 40 * 192).astype(np.uint8).tobytes()
    assert webp.samples(webp.decode(webp.encode(words))) == words and 0 < len(looks) < len(words) / 4
    payload = webp.pad(words[:500] + words[:400] * 4)
    for stretch in range(64, 80):
        monkeypatch.setattr(webp, "STRETCH", stretch)
        assert webp.samples(webp.decode(webp.encode(payload))) == payload
