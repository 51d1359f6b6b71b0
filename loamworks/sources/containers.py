"""Media payloads: kinds by their first bytes, waves at 16 kHz, sampled frames and audio tracks (SRC-11, SRC-12)."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.functions.text import let
from loamworks.sources.ingest import decode_media

# Rate and longest duration of a wave, most frames of a sample, seconds between them at least.
RATE, SECONDS = 16_000, 60
FRAMES, GAP_S = 16, 1.0
#: The first bytes of containers, as hexadecimal patterns; a dot stands for any digit.
MAGIC = {"wav": "52494646.{8}57415645", "avi": "52494646.{8}41564920", "webm": "1A45DFA3", "mp4": ".{8}66747970", "png": "89504E47", "jpeg": "FFD8FF", "gif": "47494638", "flac": "664C6143", "ogg": "4F676753", "mp3": "494433|FFFB|FFF3|FFF2"}
IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
#: OpenCV's number for three channels of a byte each, as Spark's image source has it.
BGR = 16


def container(payload: Column) -> Column:
    """The kind of a payload by its first bytes, or null."""
    head = F.hex(F.substring(payload, 1, 16))
    return F.coalesce(*[F.when(head.rlike(f"^(?:{p})"), kind) for kind, p in MAGIC.items()])


def payloads(df: DataFrame, column: str) -> DataFrame:
    """df with payload, the bytes of a base64 text or data URI, and kind; both null where there are none (SRC-11)."""
    return df.withColumn("payload", decode_media(F.col(column))).withColumn("kind", container(F.col("payload")))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files decoded by Spark's own source, a null image where a file is none (SRC-11)."""
    raw = spark.read.format("image").option("dropInvalid", False).load(path)
    return raw.select(F.col("image.origin").alias("origin"), F.when(F.col("image.nChannels") > 0, F.col("image")).alias("image"))


def _chunks(body: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks of a RIFF container; a size beyond the end is cut there."""
    while at + 8 <= end:
        name, size = bytes(body[at : at + 4]), struct.unpack_from("<I", body, at + 4)[0]
        stop = min(at + 8 + size, end)
        yield name, at + 8, stop
        at += 8 + size + size % 2


def _samples(raw: memoryview, form: tuple) -> np.ndarray:
    """Mono samples from -1 to 1 of PCM bytes; form: code, channels, bits."""
    code, channels, bits = form
    width = bits // 8 * channels
    raw = raw[: len(raw) // width * width]
    if code == 3 and bits in (32, 64):
        x = np.frombuffer(raw, f"<f{bits // 8}").astype(float)
    elif code == 1 and bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif code == 1 and bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
        x = x / float(1 << 23)
    elif code == 1 and bits in (16, 32):
        x = np.frombuffer(raw, f"<i{bits // 8}") / float(1 << (bits - 1))
    else:
        raise ValueError(f"samples of code {code} with {bits} bits")
    return x.reshape(-1, channels).mean(axis=1)


def _form(body: memoryview, at: int, end: int) -> tuple[int, tuple]:
    """Rate and (code, channels, bits) of a wave format chunk; extensible ones say their code behind."""
    code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body, at)
    if code == 0xFFFE and end - at >= 26:
        code = struct.unpack_from("<H", body, at + 24)[0]
    if not rate or not channels or bits % 8 or not bits:
        raise ValueError("no wave format")
    return rate, (code, channels, bits)


@lru_cache
def _taps(widest: int, up: int, zeros: int) -> np.ndarray:
    """A windowed sinc, of gain up."""
    n = np.arange(-zeros * widest, zeros * widest + 1)
    taps = np.sinc(n / widest) * np.kaiser(len(n), 5.0)
    return taps * (up / taps.sum())


def resampled(x: np.ndarray, rate: int, to: int = RATE, zeros: int = 10) -> np.ndarray:
    """x at another rate by a polyphase filter: a windowed sinc, of which each output sample needs one phase."""
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    if up == down or not len(x):
        return x
    half, taps = zeros * max(up, down), _taps(max(up, down), up, zeros)
    total = -(-len(x) * up // down)
    reach = -(-half // up)
    padded = np.concatenate([np.zeros(reach), x, np.zeros(reach + 1)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1)
    j = np.arange(-reach, reach + 1)
    out = np.zeros(total)
    for phase in range(min(up, total)):
        first, shift = phase * down // up, phase * down % up  # the first sample of one phase; the others follow down apart
        n = len(range(phase, total, up))
        place = shift - j * up + half  # the tap that meets each neighbour
        good = (place >= 0) & (place < len(taps))
        weights = np.where(good, taps[np.clip(place, 0, len(taps) - 1)], 0.0)
        if down == 1:  # neighbouring windows: no copy of each is made
            out[phase::up] = np.correlate(padded[first : first + n + 2 * reach], weights, "valid")
        else:
            out[phase::up] = windows[first :: down][:n] @ weights
    return out


def wave_of(body: bytes) -> np.ndarray | None:
    """Mono samples at RATE of the first SECONDS of a WAV file or an AVI's audio track; null where there is none."""
    view = memoryview(body)
    try:
        if view[:4] != b"RIFF":
            return None
        if view[8:12] == b"WAVE":
            found = {name: (a, b) for name, a, b in _chunks(view, 12, len(view))}
            rate, form = _form(view, *found[b"fmt "])
            raw = view[slice(*found[b"data"])]
        else:
            tracks, pieces, _ = _film(view)
            n, (rate, form) = next((n, t["wave"]) for n, t in enumerate(tracks) if t["wave"])
            raw = memoryview(b"".join(view[a:b] for name, a, b in pieces if name == b"%02dwb" % n))
        raw = raw[: SECONDS * rate * form[1] * form[2] // 8]
        return resampled(_samples(raw, form), rate)[: SECONDS * RATE]
    except (KeyError, ValueError, StopIteration, struct.error, ZeroDivisionError):
        return None


def _film(view: memoryview) -> tuple[list[dict], list[tuple[bytes, int, int]], int]:
    """Tracks, data chunks in order, and microseconds per frame of an AVI file; lists are walked without reading data."""
    if view[:4] != b"RIFF" or view[8:12] != b"AVI ":
        raise ValueError("no film")
    tracks, pieces, pause = [], [], 40_000
    todo = [(12, len(view))]
    while todo:
        at, end = todo.pop()
        inner = []
        for name, a, b in _chunks(view, at, end):
            if name == b"LIST":
                inner.append((a + 4, b))
            elif name == b"avih":
                pause = struct.unpack_from("<I", view, a)[0] or pause
            elif name == b"strh":
                tracks.append({"type": bytes(view[a : a + 4]), "wave": None, "size": None})
            elif name == b"strf" and tracks and tracks[-1]["type"] == b"auds":
                tracks[-1]["wave"] = _form(view, a, b)
            elif name == b"strf" and tracks and tracks[-1]["type"] == b"vids":
                _, w, h, _, bits, code = struct.unpack_from("<IiiHHI", view, a)
                tracks[-1]["size"] = (w, h, bits, code)
            elif len(name) == 4 and name[:2].isdigit() and name[2:] in (b"wb", b"dc", b"db"):
                pieces.append((name, a, b))
        todo += inner[::-1]
    return tracks, pieces, pause


def sampled(total: int, seconds: float) -> list[int]:
    """The frames of a sample: evenly from the first to the last, the middle one of a short film."""
    n = min(FRAMES, max(1, int(seconds / GAP_S)))
    return [total // 2] if n <= 1 else [int(i * (total - 1) / (n - 1)) for i in range(n)]


def frames_of(body: bytes) -> list[dict]:
    """The sampled frames of a film: place, at (seconds), bytes, and the image of those stored without compression."""
    view = memoryview(body)
    try:
        tracks, pieces, pause = _film(view)
        n, track = next((n, t) for n, t in enumerate(tracks) if t["size"])
        own = [(a, b) for name, a, b in pieces if name[:2] == b"%02d" % n]
        if not own:
            return []
        out = []
        w, h, bits, code = track["size"]
        for place in sampled(len(own), len(own) * pause / 1e6):
            raw = bytes(view[slice(*own[place])])
            image, row = None, -(-w * 3 // 4) * 4
            if code == 0 and bits == 24 and len(raw) >= row * abs(h):  # rows of BGR, padded, from the bottom unless h < 0
                pixels = np.frombuffer(raw, np.uint8, row * abs(h)).reshape(abs(h), row)[:, : w * 3]
                pixels = pixels[::-1] if h > 0 else pixels
                image = {"origin": None, "height": abs(h), "width": w, "nChannels": 3, "mode": BGR, "data": pixels.tobytes()}
            out.append({"place": place, "at": place * pause / 1e6, "bytes": raw, "image": image})
        return out
    except (ValueError, StopIteration, struct.error):
        return []


_IMAGE = pa.struct([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())])


def waves(df: DataFrame, key: str, payload: str) -> DataFrame:
    """key and wave: samples at 16 kHz of WAV payloads or audio tracks, null where a payload is none; one payload at a time in memory."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                body = batch.column(1)[i].as_py()
                wave = None if body is None else wave_of(body)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([wave], pa.list_(pa.float32()))], [key, "wave"])

    return df.select(key, payload).mapInArrow(run, f"{key} {kind}, wave array<float>")


def frames(df: DataFrame, key: str, payload: str) -> DataFrame:
    """key, place, at, bytes and image for each sampled frame of film payloads; those that are none have no rows (SRC-12)."""
    kind = df.schema[key].dataType.simpleString()
    fields = [pa.int64(), pa.float64(), pa.binary(), _IMAGE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = frames_of(batch.column(1)[i].as_py() or b"")
                if found:
                    keys = pa.array([batch.column(0)[i].as_py()] * len(found), batch.schema.field(0).type)
                    columns = [pa.array([f[name] for f in found], t) for name, t in zip(("place", "at", "bytes", "image"), fields, strict=True)]
                    yield pa.RecordBatch.from_arrays([keys, *columns], [key, "place", "at", "bytes", "image"])

    return df.select(key, payload).mapInArrow(run, f"{key} {kind}, place long, at double, bytes binary, image {IMAGE}")


def little(n: Column, size: int) -> Column:
    """A number's bytes, the lowest first."""
    byte = lambda i: F.lpad(F.hex(F.shiftrightunsigned(n.cast("long"), 8 * i).bitwiseAND(F.lit(255).cast("long"))), 2, "0")
    return F.unhex(F.concat(*[byte(i) for i in range(size)]))


def wav_payload(samples: Column, rate: int) -> Column:
    """A WAV file of 8-bit mono samples."""
    name = lambda s: F.lit(s.encode())
    n = F.length(samples)
    form = F.concat(name("fmt "), little(F.lit(16), 4), little(F.lit(1), 2), little(F.lit(1), 2), little(F.lit(rate), 4), little(F.lit(rate), 4), little(F.lit(1), 2), little(F.lit(8), 2))
    return F.concat(name("RIFF"), little(n + 36, 4), name("WAVE"), form, name("data"), little(n, 4), samples)


def film_payload(samples: Column, side: int = 16, pause: int = 500_000) -> Column:
    """An AVI film of square frames stored without compression, filled with the samples from the start; side is a multiple of 4."""
    name = lambda s: F.lit(s.encode())
    size = side * side * 3
    total = F.ceil(F.greatest(F.length(samples), F.lit(1)) / size).cast("int")
    zero = lambda n: F.lit(bytes(n))
    padded = F.concat(samples, F.unhex(F.repeat(F.lit("00"), total * size - F.length(samples))))
    frame = F.concat(name("00db"), little(F.lit(size), 4))
    listed = lambda kind, body: let(body, lambda b: F.concat(name("LIST"), little(F.length(b) + 4, 4), name(kind), b))
    cut = let(padded, lambda p: F.transform(F.sequence(F.lit(1), (F.length(p) / size).cast("int")), lambda i: F.hex(F.concat(frame, F.substr(p, (i - 1) * size + 1, F.lit(size))))))
    main = F.concat(name("avih"), little(F.lit(56), 4), little(F.lit(pause), 4), zero(12), little(total, 4), zero(36))
    head = F.concat(name("strh"), little(F.lit(56), 4), name("vids"), zero(52))
    form = F.concat(name("strf"), little(F.lit(40), 4), little(F.lit(40), 4), little(F.lit(side), 4), little(F.lit(side), 4), little(F.lit(1), 2), little(F.lit(24), 2), zero(24))
    lists = F.concat(listed("hdrl", F.concat(main, listed("strl", F.concat(head, form)))), listed("movi", F.unhex(F.array_join(cut, ""))))
    return let(lists, lambda x: F.concat(name("RIFF"), little(F.length(x) + 4, 4), name("AVI "), x))


def image_of(samples: Column, width: int = 16) -> Column:
    """An image row of three channels, filled with the samples from the start; no samples give none."""
    height = F.ceil(F.length(samples) / (3 * width)).cast("int")
    data = F.concat(samples, F.unhex(F.repeat(F.lit("00"), height * 3 * width - F.length(samples))))
    fields = (F.lit(None).cast("string"), height, F.lit(width), F.lit(3), F.lit(BGR), data)
    names = ("origin", "height", "width", "nChannels", "mode", "data")
    return F.when(F.length(samples) > 0, F.struct(*[v.alias(n) for n, v in zip(names, fields, strict=True)]))
