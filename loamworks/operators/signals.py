"""Measures and prints of waves and pixels, in Arrow batches over columns of samples and images (V-09, V-10, V-23)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamworks.operators.valuation import acoustic_print
from loamworks.sources.containers import RATE, wave_of

# Frames and steps of the spectrum, bands and coefficients, the speech band.
FFT, HOP, BANDS, COEFFICIENTS = 2048, 512, 128, 40
SPEECH = (300.0, 3400.0)
WAVE = ("seconds", "entropy", "snr", "structure")
PIXEL = ("entropy", "edges", "colours", "resolution")
SIDE, LOW = 32, 8
#: Frames that are measured at a time.
STRIP = 128


@lru_cache
def mel_bank(rate: int = RATE) -> np.ndarray:
    """Triangular filters of equal area, evenly spread over the mel scale, which is linear below 1 kHz and logarithmic above."""
    step = math.log(6.4) / 27
    to_mel = lambda f: f * 3 / 200 if f < 1000 else 15 + math.log(f / 1000) / step
    edges = np.array([m * 200 / 3 if m < 15 else 1000 * math.exp(step * (m - 15)) for m in np.linspace(0, to_mel(rate / 2), BANDS + 2)])
    bins = np.fft.rfftfreq(FFT, 1 / rate)
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid))) * (2 / (high - low))


def _framed(padded: np.ndarray) -> np.ndarray:
    """Overlapping frames of a padded wave, around every HOP-th sample; a view."""
    step = padded.strides[0]
    return np.lib.stride_tricks.as_strided(padded, ((len(padded) - FFT) // HOP + 1, FFT), (HOP * step, step), writeable=False)


def _strips(views: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The frames of some waves one after another, STRIP of them in memory at most."""
    held, n = [], 0
    for view in views:
        for at in range(0, len(view), STRIP):
            part = view[at : at + STRIP]
            if n + len(part) > STRIP:
                yield np.concatenate(held)
                held, n = [], 0
            held.append(part)
            n += len(part)
    if held:
        yield np.concatenate(held)


@lru_cache
def hann() -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FFT) / FFT)


def spectrum(frames: np.ndarray) -> np.ndarray:
    """Power by frame and frequency, under a Hann window, which is laid over the frames in place."""
    frames *= hann()
    x = np.fft.rfft(frames, axis=1)
    power = x.real * x.real
    power += x.imag * x.imag
    return power


@lru_cache
def cosine_transform(n: int) -> np.ndarray:
    """Rows of the orthonormal cosine transform of length n."""
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    rows = np.cos(np.pi * k * (2 * i + 1) / (2 * n)) * math.sqrt(2 / n)
    rows[0] /= math.sqrt(2)
    return rows


def _percentile(x: np.ndarray, share: float) -> float:
    """numpy's percentile by linear interpolation, without its cost for a few values."""
    x, at = np.sort(x), share * (len(x) - 1)
    low = int(at)
    a, b = float(x[low]), float(x[min(low + 1, len(x) - 1)])
    return a + (b - a) * (at - low)


def deltas(c: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
    """Mean variance of each wave's first or second derivatives over frames, by a least-squares line or parabola through nine of them.

    The outer frames have the derivatives of their neighbours; waves of under nine frames have no change.
    """
    out, long = np.zeros(len(counts)), np.flatnonzero(counts >= 9)
    if not len(long):
        return out
    n = np.arange(-4.0, 5.0)
    weights = n / (n @ n) if order == 1 else 2 * (n * n - (n * n).mean()) / (((n * n - (n * n).mean()) ** 2).sum())
    inner = sum(w * c[i : len(c) - 8 + i] for i, w in enumerate(weights))
    size = counts[long]
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first, size)
    place = np.clip(place, 4, np.repeat(size - 5, size)) - 4 + np.repeat((np.cumsum(counts) - counts)[long], size)
    x = inner[place]
    away = x - np.repeat(np.add.reduceat(x, first, axis=0) / size[:, None], size, axis=0)
    out[long] = (np.add.reduceat(away * away, first, axis=0) / size[:, None]).mean(axis=1)
    return out


def measured(waves: list[np.ndarray]) -> list[tuple[float, float, float, float]]:
    """Seconds, spectral entropy, signal-to-noise and structure of each wave that isn't empty, the last three from 0 to 100.

    The frames of all waves go through each step together, as a wave alone is too short to pay for the calls.
    """
    padded = [np.concatenate([np.zeros(FFT // 2), x, np.zeros(FFT // 2)]) for x in waves]
    views = [_framed(x) for x in padded]
    counts = np.array([len(v) for v in views])
    starts = np.cumsum(counts) - counts
    bins = np.fft.rfftfreq(FFT, 1 / RATE)
    low, high = np.searchsorted(bins, SPEECH[0]), np.searchsorted(bins, SPEECH[1], "right")
    parts = []
    for frames in _strips(views):
        power = spectrum(frames)
        share = power / (power.sum(axis=1, keepdims=True) + 1e-10)
        bits = share + 1e-10
        np.log2(bits, out=bits)
        bits *= share
        bits = -bits.sum(axis=1)
        db = 10 * np.log10(np.maximum(power @ mel_bank().T, 1e-10))
        parts.append((bits, power[:, low:high].mean(axis=1), power.mean(axis=1), db))
    bits, speech, mean, db = (np.concatenate(p) for p in zip(*parts, strict=True))
    bits, speech = np.add.reduceat(bits, starts) / counts, np.add.reduceat(speech, starts) / counts
    loudest = np.maximum.reduceat(db.max(axis=1), starts)
    c = np.maximum(db, np.repeat(loudest - 80, counts)[:, None]) @ cosine_transform(BANDS)[:COEFFICIENTS].T  # at most 80 below the loudest
    change = [deltas(c, counts, order) for order in (1, 2)]
    loud = np.sqrt(np.concatenate([_framed(x * x).mean(axis=1) for x in padded]))
    of = np.repeat(np.arange(len(waves)), counts)
    peak = np.flatnonzero(np.diff(np.sign(np.diff(loud))) == -2)
    peaks = np.bincount(of[peak[of[peak] == of[peak + 2]]], minlength=len(waves))
    out = []
    for i, x in enumerate(waves):
        entropy = min(100.0, float(bits[i]) / math.log2(FFT // 2 + 1) * 100)
        floor = _percentile(np.sqrt(mean[starts[i] : starts[i] + counts[i]]), 0.15) ** 2 + 1e-12
        snr = min(100.0, max(0.0, 10 * math.log10(max(float(speech[i]) / floor, 1e-6)) / 40 * 100))
        rate = int(peaks[i]) / max(len(x) / RATE, 0.1)
        structure = 0.45 * min(100.0, float(change[0][i]) / 30 * 100) + 0.30 * min(100.0, float(change[1][i]) / 20 * 100) + 0.25 * min(100.0, rate / 8 * 100)
        out.append((len(x) / RATE, entropy, snr, structure))
    return out


def wave_measures_of(x: np.ndarray) -> tuple[float, float, float, float]:
    """The measures of one wave."""
    return measured([x])[0]


def half_seconds(x: np.ndarray) -> list[float]:
    """Energy of whole half seconds."""
    size = RATE // 2
    return [float(v) for v in np.sqrt((x[: len(x) // size * size].reshape(-1, size) ** 2).mean(axis=1))]


def _mapped(df: DataFrame, column: str, fields: dict[str, str], of: Callable) -> DataFrame:
    """df without column, with fields: what of gives for each of some values, nulls for null."""
    kept = [c for c in df.columns if c != column and c not in fields]
    kinds = {"double": pa.float64(), "long": pa.int64(), "string": pa.string(), "array<double>": pa.list_(pa.float64()), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                out = of(some.column(0))
                made = [pa.array([None if o is None else o[i] for o in out], kinds[k]) for i, k in enumerate(fields.values())]
                yield pa.RecordBatch.from_arrays([*some.columns[1:], *made], [*kept, *fields])

    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept], *[f"{n} {k}" for n, k in fields.items()]])
    return df.select(column, *kept).mapInArrow(run, schema)


def _waves_measured(values: Iterator[np.ndarray | None]) -> list[tuple | None]:
    """What wave_measures gives for each wave; waves of STRIP frames together are in memory, or a longer one."""
    out: list[tuple | None] = []
    held: list[tuple[int, np.ndarray]] = []

    def settle() -> None:
        for (i, x), found in zip(held, measured([x for _, x in held]), strict=True):
            short = "0xAUD_" + hashlib.sha256(x.astype("<f4").tobytes()[:1024]).hexdigest()[:12].upper() if len(x) < RATE else None
            out[i] = (*found, half_seconds(x), short)
        held.clear()

    frames = 0
    for x in values:
        out.append(None)
        if x is None or not len(x):
            continue
        if held and frames + len(x) // HOP + 1 > STRIP:
            settle()
            frames = 0
        held.append((len(out) - 1, x))
        frames += len(x) // HOP + 1
    if held:
        settle()
    return out


def _with_prints(df: DataFrame, column: str, wave: Callable) -> DataFrame:
    out = _mapped(df, column, {**dict.fromkeys(WAVE, "double"), "__lw_rms": "array<double>", "__lw_short": "string"}, lambda values: _waves_measured(map(wave, values)))
    return out.withColumn("print", F.coalesce("__lw_short", acoustic_print(F.col("__lw_rms")))).drop("__lw_rms", "__lw_short")


def wave_measures(df: DataFrame, wave: str) -> DataFrame:
    """df with seconds, entropy, snr, structure and print of a column of samples at 16 kHz in place of it (V-10, V-23).

    A null or empty wave has nulls. The print is that of the energy of half seconds; waves under a second have one of their samples.
    """
    return _with_prints(df, wave, lambda v: v.values.to_numpy(zero_copy_only=False).astype(float) if v.is_valid else None)


def payload_measures(df: DataFrame, payload: str) -> DataFrame:
    """wave_measures of the waves of a column of WAV payloads or audio tracks (containers.waves); samples stay in the task that decodes them."""

    def wave(value: pa.Scalar) -> np.ndarray | None:
        x = wave_of(value.as_py()) if value.is_valid else None
        return None if x is None else x.astype(np.float32).astype(float)

    return _with_prints(df, payload, wave)


def pixels(image: dict) -> np.ndarray | None:
    """Height x width x (blue, green, red) of an image row; null where it is none."""
    h, w, n, data = image["height"], image["width"], image["nChannels"], image["data"]
    if not h or not w or h < 0 or w < 0 or n not in (1, 3, 4) or data is None or len(data) < h * w * n:
        return None
    p = np.frombuffer(data, np.uint8, h * w * n).reshape(h, w, n)
    return np.repeat(p, 3, axis=2) if n == 1 else p[:, :, :3]


def grey(p: np.ndarray) -> np.ndarray:
    """Luma, rounded, from 0 to 255."""
    b, g, r = (p[:, :, i].astype(np.int64) for i in range(3))
    return (r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16


def pixel_measures_of(p: np.ndarray) -> tuple[float, float, float, float]:
    """Histogram entropy, share of edges, share of hues, and share of a million pixels.

    An edge is a pixel that eight times exceeds the sum of its neighbours by over 20; border pixels stand for themselves.
    """
    entropy = 0.0
    for i in range(3):
        share = np.bincount(p[:, :, i].reshape(-1), minlength=256) / p[:, :, i].size
        share = share[share > 0]
        entropy += float(-(share * np.log2(share)).sum()) / 3
    g = grey(p)
    edge = g.copy()
    if min(g.shape) > 2:
        total = sum(g[1 + a : g.shape[0] - 1 + a, 1 + b : g.shape[1] - 1 + b] for a in (-1, 0, 1) for b in (-1, 0, 1))
        edge[1:-1, 1:-1] = np.clip(9 * g[1:-1, 1:-1] - total, 0, 255)
    b, gr, r = (p[:, :, i].astype(float) for i in range(3))
    top, low = np.maximum(np.maximum(r, gr), b), np.minimum(np.minimum(r, gr), b)
    span = np.where(top > low, top - low, 1)
    hue = np.where(r == top, (gr - b) / span, np.where(gr == top, 2 + (b - r) / span, 4 + (r - gr) / span)) / 6 % 1.0
    hue = np.where(top > low, (hue * 255).astype(int), 0)
    return min(8.0, entropy), float((edge > 20).mean()), len(np.unique(hue // 16)) / 16, min(1.0, p.shape[0] * p.shape[1] / 1024**2)


def phash(p: np.ndarray) -> int:
    """64 bits, signed: low cosine frequencies of the luma at 32 x 32 (means of areas) above their median."""
    g = grey(p).astype(float)
    for axis in (0, 1):
        edges = np.linspace(0, g.shape[axis], SIDE + 1)
        sums = np.concatenate([np.zeros_like(g.take([0], axis)), g.cumsum(axis)], axis)
        at = np.minimum(edges.astype(int), g.shape[axis] - 1)
        part = edges - at
        shape = [-1 if a == axis else 1 for a in (0, 1)]
        whole = sums.take(at, axis) + g.take(at, axis) * part.reshape(shape)
        g = np.diff(whole, axis=axis) / (g.shape[axis] / SIDE)
    low = (cosine_transform(SIDE) @ g @ cosine_transform(SIDE).T)[:LOW, :LOW]
    bits = (low > np.median(low)).reshape(-1)
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - (1 << 64) if value >= 1 << 63 else value


def pixel_measures(df: DataFrame, image: str) -> DataFrame:
    """df with entropy, edges, colours, resolution, aspect_ok and print of a column of Spark's images in place of it (V-09, V-23).

    Null images and those that can't be read have nulls. The print has 64 bits, of which a similar image shares most.
    """

    def each(value: pa.Scalar) -> tuple | None:
        p = pixels(value.as_py()) if value.is_valid else None
        return None if p is None else (*pixel_measures_of(p), 0.5 < p.shape[1] / p.shape[0] < 2.0, phash(p))

    return _mapped(df, image, {**dict.fromkeys(PIXEL, "double"), "aspect_ok": "boolean", "print": "long"}, lambda values: [each(v) for v in values])


def film_prints(frames: DataFrame, key: str, place: str = "place", print_: str = "print") -> DataFrame:
    """key, print (each bit as in most of the film's frames, for near films) and code (of all frames' prints, for equal ones) (V-23).

    A film has 16 sampled frames at most. Frames without a print are left out; a film without any has nulls.
    """
    known = F.col(print_).isNotNull()
    listed = F.array_sort(F.collect_list(F.when(known, F.struct(place, print_)))).alias("listed")
    each = frames.groupBy(key).agg(listed, *[F.sum(F.when(known, F.when(F.getbit(print_, F.lit(i)) == 1, 1).otherwise(-1))).alias(f"b{i}") for i in range(64)])
    value: Column = F.lit(0).cast("long")
    for i in range(64):
        value = value.bitwiseOR(F.when(F.col(f"b{i}") > 0, F.lit((1 << i) if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    code = F.upper(F.substring(F.sha2(F.array_join(F.transform("listed", lambda x: F.lower(F.lpad(F.hex(x[print_]), 16, "0"))), ""), 256), 1, 16))
    empty = F.size("listed") == 0
    return each.select(key, F.when(~empty, value).alias("print"), F.when(~empty, code).alias("code"))
