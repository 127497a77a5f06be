"""Motion-JPEG in AVI as media columns.

Writing: bytes become 16 x 12 frames of 8-bit grey samples; a frame is a lossless JPEG (SOF3,
predictor 1) and the frames go into a RIFF AVI file with an idx1 index. Reading: the RIFF chunks
and the index are parsed, each frame is decoded from its own JPEG data, and shots are cut where
the histogram difference of neighbouring frames exceeds the mean plus a multiple of the deviation
of the differences around it.

The Huffman table gives the difference category s (0 to 8) a code of 9 - s bits, so category plus
the s bits that follow always take 9 bits: a sample is one 9-bit field, and whole frames are coded
with array operations. Other lossless files (any table, size and predictor) and the usual lossy ones
(baseline frames, SOF0 and SOF1, any sampling; the luminance is read) are decoded bit by bit; a frame
without Huffman or quantisation tables has those of the frame before it.

Defined results: a null text is the empty text; it is stored as one frame of spaces. Equal texts
have equal files. Media that are no AVI file, are cut short or hold frames that cannot be decoded
give one clip row with the error and nulls; null media and files without frames give no clip. An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideflow.llm.common import extended, text_of

WIDTH, HEIGHT, FRAMES_A_SECOND = 16, 12, 25
UNIT = WIDTH * HEIGHT
CATEGORIES = 8


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """9-bit field of each difference (-255 to 255, offset 255), and the difference of each field."""
    field, difference = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = (1 << (CATEGORIES + 1 - s)) - 2  # 8 - s ones, then a zero
        field[d + 255] = prefix << s | (d if d >= 0 else d + (1 << s) - 1)
        difference[field[d + 255]] = d
    return field, difference


FIELD, DIFFERENCE = _codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg_head(width: int, height: int) -> bytes:
    """SOI, lossless frame header, the Huffman table above, and the scan header."""
    table = bytes([0, *([1] * (CATEGORIES + 1)), *([0] * (16 - CATEGORIES - 1)), *range(CATEGORIES, -1, -1)])
    return b"\xff\xd8" + _segment(0xC3, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)) + _segment(0xC4, table) + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))


HEAD, TAIL = jpeg_head(WIDTH, HEIGHT), b"\xff\xd9"


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Entropy-coded data of each frame; samples: (frames, height, width) uint8, frames of UNIT samples."""
    x = samples.astype(np.int16)
    d = x.copy()
    d[:, :, 1:] -= x[:, :, :-1]
    d[:, 1:, 0] -= x[:, :-1, 0]
    d[:, 0, 0] -= 128
    fields = FIELD[d.reshape(len(x), -1) + 255]
    bits = np.unpackbits(fields.astype(">u2")[..., None].view(np.uint8), axis=-1)[..., 7:]
    packed = np.packbits(bits.reshape(len(x), -1), axis=1)
    full = packed == 0xFF
    flat, ends = packed.ravel(), np.cumsum(packed.shape[1] + full.sum(1))
    stuffed = np.insert(flat, np.flatnonzero(full.ravel()) + 1, 0).tobytes()
    return [stuffed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def write_avi(samples: np.ndarray) -> bytes:
    """An AVI file with one MJPG stream."""
    n = len(samples)
    frames = [HEAD + data + TAIL for data in encode_frames(samples)]
    avih = struct.pack("<14I", 1_000_000 // FRAMES_A_SECOND, 0, 0, 0x10, n, 0, 1, 0, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FRAMES_A_SECOND, 0, n, 0, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", UNIT, 0, 0, 0, 0)
    strl = _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf))
    movi, index, at = [], [], 4
    for frame in frames:
        movi.append(_chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(movi[-1])
    body = b"AVI " + _list(b"hdrl", _chunk(b"avih", avih) + strl) + _list(b"movi", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def chunks(data: memoryview, at: int, end: int):
    """(name, kind of a list, body start, body end) of the chunks between two offsets."""
    while at + 8 <= end:
        name, size = bytes(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
        kind = bytes(data[at + 8 : at + 12]) if name in (b"RIFF", b"LIST") else b""
        yield name, kind, at + 8 + len(kind), min(end, at + 8 + size)
        at += 8 + size + size % 2


def read_index(data: bytes) -> tuple[float, list[tuple[int, int]]]:
    """Seconds a frame, and (start, length) of each video frame, from idx1 (or the movi list if there is none)."""
    view = memoryview(data)
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    if struct.unpack_from("<I", data, 4)[0] + 8 > len(data):
        raise ValueError("the file is cut short")
    step, movi, index, found = 1 / FRAMES_A_SECOND, None, None, []
    for _, _, a, b in chunks(view, 0, len(data)):
        for name, kind, a, b in chunks(view, a, b):
            if kind == b"hdrl":
                step = next((struct.unpack_from("<I", view, s)[0] / 1e6 for n, _, s, _ in chunks(view, a, b) if n == b"avih"), step)
            elif kind == b"movi":
                movi = (a, b)
            elif name == b"idx1":
                index = (a, b)
    if movi is None:
        return step, []
    if index is None:
        return step, [(s, e - s) for n, _, s, e in chunks(view, *movi) if n[2:] in (b"dc", b"db")]
    entries = np.frombuffer(data[index[0] : index[1]], "<u4", (index[1] - index[0]) // 16 * 4).reshape(-1, 4)
    video = ((entries[:, 0] >> 16) == 0x6364) | ((entries[:, 0] >> 16) == 0x6264)
    entries = entries[video]
    base = movi[0] - 4 if len(entries) and entries[0, 2] < movi[0] else 0  # offsets count from the list's kind, or from the file's start
    found = [(base + int(o) + 8, int(n)) for o, n in entries[:, 2:]]
    if any(at + n > len(data) for at, n in found):
        raise ValueError("the index points beyond the file's end")
    return step, found


def decode_frames(data: bytes, places: list[tuple[int, int]]) -> np.ndarray:
    """(frames, height, width) uint8 of JPEG frames."""
    usual = [data.startswith(HEAD, at) for at, _ in places]
    if places and all(usual):
        return _decode_usual(data, places)
    tables: dict = {}
    frames = [decode_any(data[at : at + n], tables) for at, n in places]
    if len({f.shape for f in frames}) > 1:
        raise ValueError("frames of different sizes")
    return np.stack(frames) if frames else np.zeros((0, HEIGHT, WIDTH), np.uint8)


def _decode_usual(data: bytes, places: list[tuple[int, int]]) -> np.ndarray:
    scans = b"".join([data[at + len(HEAD) : at + n - len(TAIL)] for at, n in places])
    raw = np.frombuffer(scans, np.uint8)
    stuffing = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] == 0)) + 1
    packed = np.delete(raw, stuffing).reshape(len(places), -1)
    bits = np.unpackbits(packed, axis=1)[:, : UNIT * 9].reshape(len(places), UNIT, 9)
    high = np.packbits(bits, axis=-1).astype(np.uint16)
    d = DIFFERENCE[high[..., 0] << 1 | high[..., 1] >> 7].reshape(-1, HEIGHT, WIDTH).astype(np.int32)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return (np.cumsum(d, axis=2) & 0xFF).astype(np.uint8)


class Bits:
    """Reads an entropy-coded segment without its stuffing."""

    def __init__(self, data: bytes):
        raw = data.replace(b"\xff\0", b"\xff")
        self.stream, self.at = np.unpackbits(np.frombuffer(raw, np.uint8)).tolist(), 0

    def symbol(self, codes: dict) -> int:
        code = bits = 0
        while True:
            code, bits, self.at = code << 1 | self.stream[self.at], bits + 1, self.at + 1
            if (bits, code) in codes:
                return codes[bits, code]
            if bits > 16:
                raise ValueError("no such Huffman code")

    def number(self, size: int) -> int:
        """A difference or coefficient of ``size`` bits: values whose first bit is 0 are negative."""
        if not size:
            return 0
        value = 0
        for bit in self.stream[self.at : self.at + size]:
            value = value << 1 | bit
        self.at += size
        return value if value >> (size - 1) else value - (1 << size) + 1


def decode_any(jpeg: bytes, tables: dict | None = None) -> np.ndarray:
    """The samples, or the luminance, of one frame; tables holds those of the frames before it and is extended."""
    tables = {} if tables is None else tables
    at, frame, every = 2, None, 0
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while True:
        if at + 4 > len(jpeg):
            raise ValueError("a frame without a scan")
        marker, length = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + length]
        at += 2 + max(2, length)
        if marker in (0xC0, 0xC1, 0xC3):
            frame = (marker, body)
        elif marker == 0xC4:
            while len(body) >= 17:
                codes, code, k = {}, 0, 17
                for bits, count in enumerate(body[1:17], 1):
                    for _ in range(count):
                        codes[bits, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables["huffman", body[0]] = codes
                body = body[k:]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                tables["quantum", body[0] & 15] = values
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xDD:
            every = struct.unpack_from(">H", body)[0]
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("a scan without a frame header")
            scan = re.split(rb"\xff[\xd0-\xd7]", jpeg[at : jpeg.rindex(TAIL)] if TAIL in jpeg[at:] else jpeg[at:])
            return (_lossless if frame[0] == 0xC3 else _baseline)(frame[1], body, scan, tables, every)
        elif 0xC0 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("progressive, hierarchical and arithmetic frames are not read")


def _lossless(header: bytes, scan: bytes, parts: list[bytes], tables: dict, every: int) -> np.ndarray:
    height, width = struct.unpack_from(">HH", header, 1)
    if header[0] != 8 or header[5] != 1 or every:
        raise ValueError("only 8-bit lossless frames of one component without restarts are read")
    codes, predictor, bits = tables["huffman", scan[2] >> 4], scan[-3], Bits(parts[0])
    out = np.zeros((height, width), np.int32)
    for y in range(height):
        for x in range(width):
            difference = bits.number(bits.symbol(codes))
            if y == 0:
                guess = 128 if x == 0 else out[y, x - 1]
            elif x == 0:
                guess = out[y - 1, x]
            else:
                a, b, c = int(out[y, x - 1]), int(out[y - 1, x]), int(out[y - 1, x - 1])
                guess = (a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[predictor - 1]
            out[y, x] = (guess + difference) & 0xFF
    return out.astype(np.uint8)


#: Row and column of each coefficient in zigzag order: diagonals, every other one upwards.
ZIGZAG = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
COSINE = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _baseline(header: bytes, scan: bytes, parts: list[bytes], tables: dict, every: int) -> np.ndarray:
    """Luminance of a baseline frame whose components are in one scan."""
    height, width = struct.unpack_from(">HH", header, 1)
    if header[0] != 8 or scan[0] != header[5] or not height or not width:
        raise ValueError("only 8-bit frames with one scan are read")
    components = [(header[7 + 3 * k] >> 4, header[7 + 3 * k] & 15, header[8 + 3 * k], scan[2 + 2 * k]) for k in range(header[5])]
    if len(components) == 1:
        components = [(1, 1, *components[0][2:])]
    across, down = (max(c[k] for c in components) for k in (0, 1))
    columns, rows = -(-width // (8 * across)), -(-height // (8 * down))
    h, v = components[0][:2]
    plane = np.zeros((rows * v * 8, columns * h * 8))
    part, bits, last = 0, Bits(parts[0]), [0] * len(components)
    for unit in range(rows * columns):
        if every and unit and unit % every == 0:
            part += 1
            bits, last = Bits(parts[part]), [0] * len(components)
        for k, (wide, high, quantum, pair) in enumerate(components):
            direct, rest = tables["huffman", pair >> 4], tables["huffman", 16 | pair & 15]
            for block in range(wide * high):
                last[k] += bits.number(bits.symbol(direct))
                found, i = {0: last[k]}, 1
                while i < 64:
                    symbol = bits.symbol(rest)
                    run, size = symbol >> 4, symbol & 15
                    if not size and run != 15:
                        break
                    i += run
                    if size:
                        found[i] = bits.number(size)
                    i += 1
                if k == 0:
                    square, scale = np.zeros((8, 8)), tables["quantum", quantum]
                    for place, value in found.items():
                        square[ZIGZAG[place]] = value * scale[place]
                    y, x = (unit // columns * v + block // wide) * 8, (unit % columns * h + block % wide) * 8
                    plane[y : y + 8, x : x + 8] = COSINE.T @ square @ COSINE
    plane = plane.repeat(down // v, axis=0).repeat(across // h, axis=1)
    return np.clip(np.rint(plane[:height, :width] + 128), 0, 255).astype(np.uint8)


def shots(samples: np.ndarray, bins: int = 16, around: int = 8, factor: float = 2.0, least: float = 0.25) -> list[tuple[int, int]]:
    """[start, end) frames of each shot.

    A cut lies where the halved L1 distance of neighbouring frames' histograms is over ``least``
    and over the mean plus ``factor`` deviations of the ``around`` distances before and after.
    """
    n = len(samples)
    if n < 2:
        return [(0, n)] if n else []
    level = (samples.reshape(n, -1) // (256 // bins)).astype(np.int64)
    counts = np.bincount((np.arange(n)[:, None] * bins + level).ravel(), minlength=n * bins).reshape(n, bins)
    d = np.abs(np.diff(counts, axis=0)).sum(1) / (2 * level.shape[1])
    total, squares = (np.concatenate([[0.0], np.cumsum(x)]) for x in (d, d * d))
    low, high = np.maximum(0, np.arange(n - 1) - around), np.minimum(n - 1, np.arange(n - 1) + around + 1)
    others = np.maximum(1, high - low - 1)
    mean = (total[high] - total[low] - d) / others
    spread = np.sqrt(np.maximum(0, (squares[high] - squares[low] - d * d) / others - mean * mean))
    cuts = [0, *(np.flatnonzero((d > least) & (d > mean + factor * spread)) + 1).tolist(), n]
    return list(zip(cuts[:-1], cuts[1:]))


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def encoded(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the text's bytes as an AVI file."""

    def make():
        def work(part):
            sizes, media = [], []
            for text in part.column("__text").to_pylist():
                n, payload = payload_of(text)
                sizes.append(n)
                media.append(write_avi(np.frombuffer(payload, np.uint8).reshape(-1, HEIGHT, WIDTH)))
            return [sizes, media]

        return work

    return extended(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("__text")), "n_bytes long, media binary", make)


#: What unreadable files raise.
BROKEN = (ValueError, KeyError, IndexError, struct.error, MemoryError, OverflowError)


def clips(media: DataFrame) -> DataFrame:
    """One row a shot: (doc_id, clip, start_s, end_s, frames, error) of rows with doc_id and media; one row with the error for media that cannot be read."""

    def clips_of(data: bytes | None) -> list[dict]:
        try:
            step, places = read_index(data) if data is not None else (0.0, [])
            cut = shots(decode_frames(data, places)) if places else []
        except BROKEN as broken:
            return [{"error": f"{type(broken).__name__}: {broken}"}]
        return [{"clip": k, "start_s": a * step, "end_s": b * step, "frames": b - a} for k, (a, b) in enumerate(cut)]

    def make():
        return lambda part: [[clips_of(data) for data in part.column("media").to_pylist()]]

    out = extended(media.select("doc_id", "media"), "found array<struct<clip:int,start_s:double,end_s:double,frames:int,error:string>>", make, ("media",))
    return out.select("doc_id", F.explode("found").alias("__c")).select("doc_id", "__c.*")


def digests(media: DataFrame) -> DataFrame:
    """What the stored files hold, read back: sizes, hashes and a shot summary of each row; of unreadable media the hash and the error."""

    def digest(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6
        stored = len(data), hashlib.sha256(data).hexdigest()
        try:
            step, places = read_index(data)
            samples = decode_frames(data, places)
        except BROKEN as broken:
            return None, None, None, *stored, f"error={type(broken).__name__}: {broken}"
        payload, cut = samples.tobytes(), shots(samples)
        longest = max((b - a for a, b in cut), default=0)
        feature = f"frames={len(samples)};shots={len(cut)};longest={longest};seconds={len(samples) * step:.2f}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *stored, feature

    def make():
        return lambda part: [list(c) for c in zip(*map(digest, part.column("media").to_pylist()))] or [[]] * 6

    return extended(media, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", make, ("media",))
