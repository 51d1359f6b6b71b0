"""AVI motion-JPEG columns: RIFF indexes, intra frames, and shots by adaptive histogram differences."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Payload bytes in one minimum coded unit (three blocks of 64 coefficients) and units in a frame.
UNIT, UNITS = 192, 16
#: Microseconds that a stored frame lasts.
FRAME_US = 40_000
#: Histogram bins, frames that the threshold looks back on, deviations above their mean, and its floor.
BINS, BACK, DEVIATIONS, FLOOR = 32, 12, 3.0, 0.15
#: Bytes of media in one Arrow batch, about.
BATCH = 4 << 20

# Order of coefficients in a block.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
# Codes of each length and first symbols of the tables that frames without tables of their own mean (ISO
# 10918-1, annex K). The other symbols, each run of up to 15 zeros before a value of up to 10 bits, follow in ascending order.
USUAL = {
    0x00: ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]),
    0x01: ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]),
    0x10: ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], [
        0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14,
        0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82,
    ]),
    0x11: ([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], [
        0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22, 0x32, 0x81,
        0x08, 0x14, 0x42, 0x91, 0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0, 0x15, 0x62, 0x72, 0xD1, 0x0A, 0x16, 0x24, 0x34,
        0xE1, 0x25, 0xF1,
    ]),
}
_U, _X = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
COSINE = (np.where(_U == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _X + 1) * _U * np.pi / 16)).astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _still(units: np.ndarray) -> bytes:
    """A baseline JPEG strip of 8 lines whose quantised coefficients are the units' bytes.

    Every coefficient has 8 extra bits, which are the byte, after a Huffman code of 8 bits; predictions restart at
    each unit, so DC values stand alone.
    """
    n = len(units)
    table = bytes([0] * 7 + [1] + [0] * 8) + b"\x08"
    head = b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC0, struct.pack(">BHHB", 8, 8, 8 * n, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += _segment(0xC4, b"\x00" + table) + _segment(0xC4, b"\x10" + table) + _segment(0xDD, b"\0\1") + _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    if (units == 255).any():
        coded = [np.stack([np.zeros(UNIT, np.uint8), u], axis=1).tobytes().replace(b"\xff", b"\xff\0") for u in units]
        scan = b"".join(c + bytes([0xFF, 0xD0 + i % 8]) for i, c in enumerate(coded))
    else:
        body = np.zeros((n, 2 * UNIT + 2), np.uint8)
        body[:, 1 : 2 * UNIT : 2] = units
        body[:, -2], body[:, -1] = 0xFF, 0xD0 + np.arange(n) % 8
        scan = body.tobytes()
    return head + scan[:-2] + b"\xff\xd9"


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def store(payload: bytes) -> bytes:
    """An AVI file with an index whose frames hold the payload (a multiple of UNIT bytes) losslessly."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    frames = [_still(units[i : i + UNITS]) for i in range(0, len(units), UNITS)]
    width, size = 8 * min(UNITS, len(units)), max(map(len, frames))
    main = struct.pack("<14I", FRAME_US, size * 1_000_000 // FRAME_US, 0, 0x10, len(frames), 0, 1, size, width, 8, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, FRAME_US, 1_000_000, 0, len(frames), size, 0xFFFFFFFF, 0, 0, 0, width, 8)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, width, 8, 1, 24, b"MJPG", width * 24, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", bitmap)))
    index, at = b"", 4
    for f in frames:
        index += struct.pack("<4sIII", b"00dc", 0x10, at, len(f))
        at += 8 + len(f) + len(f) % 2
    movie = _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00dc", f) for f in frames))
    return _chunk(b"RIFF", b"AVI " + header + movie + _chunk(b"idx1", index))


def _indexed(media: bytes, at: int, stop: int, deep: bool = True) -> list[tuple[int, int]]:
    """(first, last + 1 byte) of the video frames that an index chunk's body names, itself or by the indexes it names."""
    if stop - at < 24:
        return []
    wide, kind, n, name = struct.unpack_from("<HxBI4s", media, at)
    if name[2:] not in (b"dc", b"db"):
        return []
    if kind == 0 and wide == 4 and deep:
        lists = [struct.unpack_from("<QI", media, i) for i in range(at + 24, min(at + 24 + 16 * n, stop - 15), 16)]
        return [x for first, size in lists for x in _indexed(media, first + 8, min(first + size, len(media)), False)]
    if kind == 1 and wide in (2, 3):
        (base,) = struct.unpack_from("<Q", media, at + 12)
        step = 4 * wide
        found = [struct.unpack_from("<II", media, i) for i in range(at + 24, min(at + 24 + step * n, stop - step + 1), step)]
        return [(base + first, base + first + (size & 0x7FFFFFFF)) for first, size in found]
    return []


def frames(media: bytes) -> tuple[list[bytes], float]:
    """A file's video frames in index order, or in file order without an index, and seconds per frame.

    Files over a gigabyte hold an index of indexes and further RIFF lists; it goes before the old index, which ends
    with the first list.
    """
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    seconds, movie, old, new, found = 0.0, None, [], [], []
    todo = [(0, len(media))]
    while todo:
        at, end = todo.pop()
        if at + 8 > end:
            continue
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        body, stop = at + 8, min(at + 8 + size, end)
        todo.append((at + 8 + size + size % 2, end))
        if name in (b"LIST", b"RIFF"):
            if media[body : body + 4] == b"movi" and movie is None:
                movie = body
            todo.append((body + 4, stop))
        elif name == b"avih" and stop - body >= 4:
            seconds = struct.unpack_from("<I", media, body)[0] / 1e6
        elif name == b"idx1":
            old.extend(struct.unpack_from("<4sIII", media, i) for i in range(body, stop - 15, 16))
        elif name == b"indx":
            new.extend(_indexed(media, body, stop))
        elif name[2:] in (b"dc", b"db"):
            found.append((body, stop))
    if new:
        found = new
    elif old and movie is not None:
        video = [x for x in old if x[0][2:] in (b"dc", b"db")]
        base = movie if video and media[movie + video[0][2] : movie + video[0][2] + 4] == video[0][0] else 0
        found = [(base + x[2] + 8, base + x[2] + 8 + x[3]) for x in video]
    return [media[a:b] for a, b in found], seconds


@lru_cache(32)
def _codes(body: bytes) -> list[tuple[int, int]]:
    """(length, symbol) of the Huffman code that 16 bits begin with; length 0 if with none."""
    out, code, at = [(0, 0)] * 65536, 0, 16
    for length in range(1, 17):
        for _ in range(body[length - 1]):
            room = 1 << (16 - length)
            out[code * room : (code + 1) * room] = [(length, body[at])] * room
            code, at = code + 1, at + 1
        code <<= 1
    if len(out) != 65536:
        raise ValueError("bad Huffman table")
    return out


@lru_cache
def _usual(slot: int) -> bytes:
    """The body of a table that frames without one mean."""
    counts, first = USUAL[slot]
    rest = sorted({run << 4 | bits for run in range(16) for bits in range(1, 11)} - set(first))
    return bytes(counts) + bytes((first + rest)[: sum(counts)])


def _runs(scan: bytes) -> list[bytes]:
    """The scan's restart intervals without stuffing."""
    if b"\xff" not in scan:
        return [scan]
    data = np.frombuffer(scan, np.uint8)
    marks = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] >= 0xD0) & (data[1:] <= 0xD7))
    cuts = [0, *(marks + 2).tolist(), len(scan) + 2]
    return [scan[a : b - 2].replace(b"\xff\0", b"\xff") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _blocks(run: bytes, count: int, plan: list[tuple[int, list, list]]) -> np.ndarray:
    """Coefficients of an interval's blocks in zigzag order, code by code; plan: (component, DC and AC codes) per block of a unit.

    Bits are taken from a window of a few bytes, so time grows with the interval. What lacks at its end reads as zeros.
    """
    window, have, at, last = 0, 0, 0, {}
    out = np.zeros((count, 64), np.int32)

    def fill() -> None:
        nonlocal window, have, at
        window = (window & (1 << have) - 1) << 64 | int.from_bytes(run[at : at + 8].ljust(8, b"\0"), "big")
        have, at = have + 64, at + 8

    def symbol(codes: list) -> int:
        nonlocal have
        if have < 32:
            fill()
        length, found = codes[window >> (have - 16) & 0xFFFF]
        if not length:
            raise ValueError("bad code")
        have -= length
        return found

    def value(n: int) -> int:
        nonlocal have
        if not n:
            return 0
        if n > 16:
            raise ValueError("bad value")
        if have < 32:
            fill()
        have -= n
        v = window >> have & (1 << n) - 1
        return v if v >> (n - 1) else v - (1 << n) + 1

    for b in range(count):
        part, dc, ac = plan[b % len(plan)]
        out[b, 0] = last[part] = last.get(part, 0) + value(symbol(dc))
        k = 1
        while k < 64:
            s = symbol(ac)
            if s == 0:
                break
            k += s >> 4
            if s & 15 and k < 64:
                out[b, k] = value(s & 15)
            k += 1
    return out


def coefficients(image: bytes) -> tuple[np.ndarray, list[int], dict[int, np.ndarray]]:
    """A baseline JPEG's coefficients (units, blocks in a unit, 64) in zigzag order, each block's component, and the tables by component."""
    at, quant, codes, parts, every, frame = 2, {}, {}, {}, 0, None
    while at + 4 <= len(image):
        if image[at] != 0xFF:
            raise ValueError("marker expected")
        marker, size = image[at + 1], struct.unpack_from(">H", image, at + 2)[0]
        body, at = image[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8).astype(np.float32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                codes[body[0]] = body[1:n]
                body = body[n:]
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker == 0xC0:
            frame = struct.unpack_from(">BHHB", body)
            parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(frame[3])}
        elif marker in (0xC1, 0xC2, 0xC3):
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDA:
            break
    if frame is None:
        raise ValueError("no frame header")
    chosen = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, 16 | body[2 + 2 * i] & 15) for i in range(body[0])]
    codes = {t: codes[t] if t in codes else _usual(t) for _, d, a in chosen for t in (d, a)}
    wide, high = max(p[0] for p in parts.values()), max(p[1] for p in parts.values())
    if len(chosen) == 1:
        parts = {chosen[0][0]: (1, 1, parts[chosen[0][0]][2])}
        wide = high = 1
    units = -(-frame[2] // (8 * wide)) * -(-frame[1] // (8 * high))
    owner = [c for c, _, _ in chosen for _ in range(parts[c][0] * parts[c][1])]
    end = image.rfind(b"\xff\xd9")
    scan = image[at : end if end >= at else len(image)]
    if units * len(owner) > 4 * len(scan):  # a block takes two bits at least
        raise ValueError("the frame ends early")
    runs = _runs(scan)
    lone = bytes([0] * 7 + [1] + [0] * 8) + b"\x08"
    if every == 1 and len(runs) == units and all(codes[t] == lone for _, d, a in chosen for t in (d, a)) and {len(r) for r in runs} == {128 * len(owner)}:
        extra = np.frombuffer(b"".join(runs), np.uint8).reshape(units, len(owner), 64, 2)[..., 1].astype(np.int32)
        out = np.where(extra >= 128, extra, extra - 255)
    else:
        plan = [(c, _codes(codes[d]), _codes(codes[a])) for c, d, a in chosen for _ in range(parts[c][0] * parts[c][1])]
        sizes = [min(every, units - i) for i in range(0, units, every)] if every else [units]
        out = np.concatenate([_blocks(r, n * len(plan), plan) for r, n in zip(runs, sizes, strict=True)]).reshape(units, len(plan), 64)
    return out, owner, {c: quant[parts[c][2]] for c in parts}


def luma_histogram(found: tuple) -> np.ndarray:
    """Shares of the first component's samples in BINS bins."""
    values, owner, quant = found
    first = owner[0]
    flat = (values[:, [o == first for o in owner]].reshape(-1, 64) * quant[first]).astype(np.float32)
    block = np.empty_like(flat)
    block[:, ZIGZAG] = flat
    samples = np.clip(np.rint(COSINE.T @ block.reshape(-1, 8, 8) @ COSINE) + 128, 0, 255).astype(np.int64)
    return np.bincount(samples.ravel() * BINS // 256, minlength=BINS) / samples.size


def shots(histograms: list[np.ndarray]) -> list[tuple[int, int]]:
    """(first frame, last + 1) of each shot: a cut lies where a difference stands out from those before it."""
    away = [0.5 * float(np.abs(a - b).sum()) for a, b in zip(histograms[:-1], histograms[1:], strict=True)]
    cuts, start = [0], 0
    for i, d in enumerate(away):
        before = np.array(away[max(start, i - BACK) : i] or [0.0])
        if d > max(FLOOR, before.mean() + DEVIATIONS * before.std()):
            cuts.append(i + 1)
            start = i + 1
    return list(zip(cuts, [*cuts[1:], len(histograms)], strict=True)) if histograms else []


def read(media: bytes) -> tuple[bytes, list[tuple[int, int]], float]:
    """The payload that store() put into a file, its shots and seconds per frame."""
    images, seconds = frames(media)
    found = [coefficients(i) for i in images]
    stored = [np.where(v < 0, v + 255, v).astype(np.uint8).tobytes() for v, _, _ in found]
    return b"".join(stored), shots([luma_histogram(f) for f in found]), seconds


def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        schema = pa.schema([("key", batch.schema.field(0).type), ("n_bytes", pa.int64()), ("media", pa.binary())])
        rows, size = [], 0
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            raw = (text.as_py() or "").encode()
            media = store(raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT)))
            rows.append((key.as_py(), len(raw), media))
            size += len(media)
            if size >= BATCH:
                yield _out(rows, schema)
                rows, size = [], 0
        if rows:
            yield _out(rows, schema)


def stored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, n_bytes, and media, an AVI file that holds the text's bytes and padding spaces."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_stored, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        schema = pa.schema([("key", batch.schema.field(0).type), ("clip", pa.int32()), ("first_frame", pa.int32()), ("n_frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("error", pa.string())])
        rows = []
        for key, media in zip(batch.column(0), batch.column(1), strict=True):
            try:
                images, seconds = frames(media.as_py() or b"")
                cut = shots([luma_histogram(coefficients(i)) for i in images])
                rows += [(key.as_py(), i, a, b - a, round(a * seconds, 6), round(b * seconds, 6), None) for i, (a, b) in enumerate(cut)]
            except (ValueError, KeyError, IndexError, struct.error) as why:
                rows.append((key.as_py(), None, None, None, None, None, str(why)))
        if rows:
            yield _out(rows, schema)


def clips(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """Timed clip rows of a column of motion-JPEG AVI files: one for each shot; an unreadable file gives one row with its error.

    Files without frames give none; null and empty files count as unreadable; repeated rows give their clips again, and an
    empty table none. Frames without Huffman tables are read by the usual ones, as most cameras leave them out.
    """
    kind = media.schema[key].dataType.simpleString()
    schema = f"key {kind}, clip int, first_frame int, n_frames int, start_s double, end_s double, error string"
    return media.select(F.col(key).alias("key"), column).mapInArrow(_clips, schema).withColumnRenamed("key", key)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [("key", batch.schema.field(0).type), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
        rows = []
        for key, n, media in zip(*batch.columns, strict=True):
            file = media.as_py()
            payload, cut, seconds = read(file)
            feature = f"frames={cut[-1][1]};clips=" + ",".join(f"{a * seconds:.2f}-{b * seconds:.2f}" for a, b in cut)
            rows.append((key.as_py(), n.as_py(), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), sha256(file).hexdigest(), feature))
        if rows:
            yield _out(rows, pa.schema(names))


def digest(docs: DataFrame) -> DataFrame:
    """Per document what its stored media file gives when it is read back, and its clips as a feature.

    Null and empty texts give a file of one unit of spaces. Very long texts are stored whole, in more frames. Repeated rows
    and keys have a row each, equal texts equal values, and an empty table gives none.
    """
    schema = f"key {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored(docs).mapInArrow(_read, schema).withColumnRenamed("key", "doc_id")
