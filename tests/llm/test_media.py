import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tideflow.llm import media


@given(st.binary(min_size=1, max_size=700))
def test_round_trip(data):
    payload = data + b" " * (-len(data) % media.UNIT)
    frames = np.frombuffer(payload, np.uint8).reshape(-1, media.HEIGHT, media.WIDTH)
    avi = media.write_avi(frames)
    step, places = media.read_index(avi)
    assert step == pytest.approx(0.04) and len(places) == len(frames)
    assert media.decode_frames(avi, places).tobytes() == payload
    bit_by_bit = np.stack([media.decode_any(avi[a : a + n]) for a, n in places])
    assert bit_by_bit.tobytes() == payload


def test_structure():
    avi = media.write_avi(np.zeros((3, media.HEIGHT, media.WIDTH), np.uint8))
    assert avi[:4] == b"RIFF" and avi[8:12] == b"AVI " and int.from_bytes(avi[4:8], "little") == len(avi) - 8
    names = [n for n, *_ in media.chunks(memoryview(avi), 12, len(avi))]
    assert names == [b"LIST", b"LIST", b"idx1"]
    without = avi.replace(b"idx1", b"JUNK")
    assert media.read_index(without)[1] == media.read_index(avi)[1]
    with pytest.raises(ValueError):
        media.read_index(b"RIFF\4\0\0\0WAVE")
    for _, (at, n) in zip(range(3), media.read_index(avi)[1]):
        assert avi[at : at + 2] == b"\xff\xd8" and avi[at + n - 2 : at + n] == b"\xff\xd9"


def test_other_predictors_are_read():
    """A frame with predictor 4 and the same table, written here sample by sample."""
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (4, 5)).astype(int)
    bits = ""
    for r in range(4):
        for c in range(5):
            guess = 128 if r == c == 0 else x[0, c - 1] if r == 0 else x[r - 1, 0] if c == 0 else x[r, c - 1] + x[r - 1, c] - x[r - 1, c - 1]
            d = (x[r, c] - guess + 128) % 256 - 128
            bits += f"{media.FIELD[d + 255]:09b}"
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    head = bytearray(media.jpeg_head(5, 4))
    head[-3] = 4
    assert (media.decode_any(bytes(head) + data + media.TAIL) == x).all()


def test_shots():
    flat = lambda v, n: np.full((n, media.HEIGHT, media.WIDTH), v, np.uint8)
    assert media.shots(np.concatenate([flat(0, 10), flat(100, 5), flat(200, 12)])) == [(0, 10), (10, 15), (15, 27)]
    assert media.shots(flat(7, 20)) == [(0, 20)] and media.shots(flat(7, 1)) == [(0, 1)] and media.shots(flat(7, 0)) == []


def test_rows(spark):
    texts = [(1, None), (2, ""), (3, "a" * 192), (4, "é" * 100), (5, "b" * 193), (None, "x"), (7, "x"), (8, "lorem ipsum " * 20_000)]
    df = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id long, text string, media string")
    rows = media.digests(media.encoded(df)).collect()
    assert len(rows) == len(texts)
    for row, (_, text) in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(texts, key=lambda t: (t[0] is None, t[0]))):
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    by = {r.doc_id: r for r in rows}
    assert by[None].media_sha256 == by[7].media_sha256 and by[1].media_sha256 == by[2].media_sha256
    clips = media.clips(media.encoded(df)).where("doc_id = 8").orderBy("clip").collect()
    assert clips[0].start_s == 0 and sum(c.frames for c in clips) == by[8].payload_bytes // 192
    assert all(a.end_s == pytest.approx(b.start_s) for a, b in zip(clips, clips[1:]))
    assert media.digests(media.encoded(df.limit(0))).count() == 0


def baseline(planes, sampling, every=0):
    """A baseline JPEG of planes of whole blocks, written here with 4-bit codes for categories and 9-bit codes for run-size pairs."""
    bits, parts, last = "", [], [0] * len(planes)
    height, width = planes[0].shape
    columns, rows = width // (8 * sampling[0][0]), height // (8 * sampling[0][1])

    def number(v):
        size = abs(v).bit_length()
        return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    def packed(text):
        text += "1" * (-len(text) % 8)
        return bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8)).replace(b"\xff", b"\xff\0")

    for unit in range(rows * columns):
        if every and unit and unit % every == 0:
            parts.append(packed(bits))
            bits, last = "", [0] * len(planes)
        for k, (plane, (h, v)) in enumerate(zip(planes, sampling)):
            for block in range(h * v):
                y, x = (unit // columns * v + block // h) * 8, (unit % columns * h + block % h) * 8
                coefficients = np.rint(media.COSINE @ (plane[y : y + 8, x : x + 8].astype(float) - 128) @ media.COSINE.T).astype(int)
                line = [int(coefficients[p]) for p in media.ZIGZAG]
                size, code = number(line[0] - last[k])
                last[k] = line[0]
                bits += format(size, "04b") + code
                run = 0
                for value in line[1:]:
                    if not value:
                        run += 1
                        continue
                    while run > 15:
                        bits += format(0xF0, "09b")
                        run -= 16
                    size, code = number(value)
                    bits += format(run << 4 | size, "09b") + code
                    run = 0
                bits += format(0, "09b") if run else ""
    parts.append(packed(bits))
    scan = b"".join(p + (bytes([0xFF, 0xD0 + k % 8]) if k < len(parts) - 1 else b"") for k, p in enumerate(parts))
    dc, ac = bytes([0, *([0] * 3), 12, *([0] * 12), *range(12)]), bytes([16, *([0] * 7), 0, 255, *([0] * 7), *range(255)])
    head = media._segment(0xDB, bytes([0, *([1] * 64)])) + media._segment(0xC0, bytes([8, *height.to_bytes(2, "big"), *width.to_bytes(2, "big"), len(planes)]) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(sampling)))
    head += media._segment(0xDD, every.to_bytes(2, "big")) if every else b""
    tables = media._segment(0xC4, dc) + media._segment(0xC4, ac)
    start = media._segment(0xDA, bytes([len(planes), *(x for k in range(len(planes)) for x in (k + 1, 0)), 0, 63, 0]))
    return b"\xff\xd8" + head, tables, start + scan + media.TAIL


def test_baseline_frames_are_decoded():
    rng = np.random.default_rng(0)
    smooth = lambda h, w: np.clip(np.add.outer(np.arange(h) * 3, np.arange(w) * 2) + rng.integers(0, 40, (h, w)), 0, 255).astype(np.uint8)
    for planes, sampling, every in (([smooth(16, 24)], [(1, 1)], 0), ([smooth(16, 32), smooth(8, 16), smooth(8, 16)], [(2, 2), (1, 1), (1, 1)], 0), ([smooth(24, 16)], [(1, 1)], 2)):
        head, tables, rest = baseline(planes, sampling, every)
        known = {}
        got = media.decode_any(head + tables + rest, known)
        assert got.shape == planes[0].shape and np.abs(got.astype(int) - planes[0]).max() <= 3
        assert (media.decode_any(head + rest, known) == got).all()  # tables of the frame before


def test_broken_media_give_an_error_row(spark):
    good = media.write_avi(np.random.default_rng(1).integers(0, 256, (4, media.HEIGHT, media.WIDTH)).astype(np.uint8))
    rng = np.random.default_rng(2)
    bad = [b"", b"junk", b"RIFF", good[:-40], good[:300], good[:20], good.replace(b"\xff\xd8", b"\0\0", 1), good.replace(b"AVI ", b"WAVE")]
    bad += [bytes(rng.integers(0, 256, 200).astype(np.uint8)) for _ in range(5)] + [good[:k] for k in range(0, len(good), 37)]
    for k in range(200):  # a flipped byte anywhere
        flipped = bytearray(good)
        flipped[int(rng.integers(len(good)))] ^= int(rng.integers(1, 256))
        bad.append(bytes(flipped))
    rows = [(k, bytearray(b)) for k, b in enumerate(bad)] + [(9000, None), (9001, bytearray(good))]
    df = spark.createDataFrame(rows, "doc_id long, media binary")
    got = media.clips(df).collect()
    errors = {r.doc_id for r in got if r.error}
    assert {1, 2, 3, 4, 6, 7} <= errors and all(r.clip is None and r.frames is None for r in got if r.error)
    assert not {9000, 9001} & errors and sum(r.frames for r in got if r.doc_id == 9001) == 4 and not any(r.doc_id == 9000 for r in got)
    digests = {r.doc_id: r for r in media.digests(df).collect()}
    assert len(digests) == len(rows) and digests[1].feature.startswith("error=") and digests[1].media_bytes == 4 and digests[9000].media_bytes is None
