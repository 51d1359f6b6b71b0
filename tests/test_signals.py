"""Decoding and measures of waves, images and films against plain models of the definitions."""

import base64
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loamworks.operators import joins, signals
from loamworks.plans import signals as plans
from loamworks.sources import containers

dice = np.random.default_rng(1)


def wav(raw, rate, code=1, channels=1, bits=16):
    extra = struct.pack("<HHI", 22, bits, 0) + struct.pack("<H", 1) + bytes(14) if code == 0xFFFE else b""
    form = struct.pack("<HHIIHH", code, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"LIST\x04\0\0\0abcd" + b"data" + struct.pack("<I", len(raw)) + raw
    return b"RIFF" + struct.pack("<I", len(body)) + body


def film(frames, side, pause, sound=b"", rate=8000, up=True):
    """An AVI file of raw frames (arrays of rows of BGR) and 8-bit sound, its chunks in turn, in a rec list."""
    strl = lambda kind, strf: b"strl" + b"strh" + struct.pack("<I", 56) + kind + bytes(52) + b"strf" + struct.pack("<I", len(strf)) + strf
    listed = lambda body: b"LIST" + struct.pack("<I", len(body)) + body
    bits = struct.pack("<IiiHHI", 40, side, side if up else -side, 1, 24, 0) + bytes(20)
    form = struct.pack("<HHIIHH", 1, 1, rate, rate, 1, 8)
    head = listed(b"hdrl" + b"avih" + struct.pack("<II", 56, pause) + bytes(52) + listed(strl(b"vids", bits)) + listed(strl(b"auds", form)))
    step = -(-len(sound) // max(1, len(frames)))
    chunks = b""
    for n, f in enumerate(frames):
        rows = np.pad(f[::-1] if up else f, ((0, 0), (0, 0), (0, 0))).reshape(side, -1)
        raw = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4))).tobytes()
        part = sound[n * step : (n + 1) * step]
        chunks += b"00db" + struct.pack("<I", len(raw)) + raw + b"01wb" + struct.pack("<I", len(part)) + part + b"\0" * (len(part) % 2)
    body = b"AVI " + head + listed(b"movi" + listed(b"rec " + chunks))
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize("rate", [8000, 16000, 11025, 44100, 48000])
def test_resampling_equals_stuffed_and_filtered_samples(rate):
    t = np.arange(rate // 5) / rate
    x = np.sin(2 * np.pi * 440 * t) + 0.3 * np.sin(2 * np.pi * 1500 * t)
    got = containers.resampled(x, rate)
    g = math.gcd(rate, 16000)
    up, down = 16000 // g, rate // g
    assert len(got) == -(-len(x) * up // down)
    if up != down:
        half = 10 * max(up, down)
        n = np.arange(-half, half + 1)
        taps = np.sinc(n / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
        stuffed = np.zeros(len(x) * up)
        stuffed[::up] = x
        want = np.convolve(stuffed, taps * up / taps.sum())[half:][::down][: len(got)]
        assert np.allclose(got, want, atol=1e-9)
    s = np.arange(len(got)) / 16000
    ideal = np.sin(2 * np.pi * 440 * s) + 0.3 * np.sin(2 * np.pi * 1500 * s)
    assert np.abs(got - ideal)[800:-800].max() < 0.02


def test_wave_forms_and_broken_files():
    x = dice.uniform(-0.9, 0.9, 3000)
    forms = {8: (x * 127 + 128).astype(np.uint8).tobytes(), 16: (x * 32767).astype("<i2").tobytes(), 32: (x * (2**31 - 1)).astype("<i4").tobytes()}
    forms[24] = b"".join(struct.pack("<i", int(v * (2**23 - 1)))[:3] for v in x)
    for bits, raw in forms.items():
        assert np.allclose(containers.wave_of(wav(raw, 16000, bits=bits)), x, atol=0.02)
    assert np.allclose(containers.wave_of(wav(x.astype("<f4").tobytes(), 16000, 3, 1, 32)), x, atol=1e-6)
    assert np.allclose(containers.wave_of(wav(forms[16], 16000, 0xFFFE)), x, atol=1e-3)
    two = np.column_stack([x, -x]).reshape(-1)
    assert np.abs(containers.wave_of(wav((two * 32767).astype("<i2").tobytes(), 16000, channels=2))).max() < 1e-3
    assert len(containers.wave_of(wav(bytes(16000 * 2 * 70), 16000))) == 60 * 16000
    whole = wav(forms[16], 16000)
    for broken in (b"", b"RIFF", whole[:30], b"RIFF\0\0\0\0WAVE" + bytes(40), whole[:20] + b"\xff\xff" + whole[22:], b"ID3" + bytes(50)):
        assert containers.wave_of(broken) is None
    assert len(containers.wave_of(whole[:2000])) > 500  # what is there of a cut file


def plain_wave(x):
    """The measures by their definitions, frame by frame."""
    padded = np.concatenate([np.zeros(1024), x, np.zeros(1024)])
    frames = [padded[i : i + 2048] for i in range(0, len(padded) - 2047, 512)]
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / 2048) for i in range(2048)]
    power = [np.abs(np.fft.fft(f * window))[:1025] ** 2 for f in frames]
    entropies = []
    for p in power:
        p = p / (p.sum() + 1e-10)
        entropies.append(-(p * np.log2(p + 1e-10)).sum())
    freq = [i * 16000 / 2048 for i in range(1025)]
    band = [i for i, f in enumerate(freq) if 300 <= f <= 3400]
    floor = np.percentile([math.sqrt(p.mean()) for p in power], 15) ** 2 + 1e-12
    snr = 10 * math.log10(max(np.mean([p[band].mean() for p in power]) / floor, 1e-6))
    mel = lambda f: f / (200 / 3) if f < 1000 else 15 + math.log(f / 1000) / (math.log(6.4) / 27)
    hz = lambda m: m * 200 / 3 if m < 15 else 1000 * math.exp(math.log(6.4) / 27 * (m - 15))
    edges = [hz(mel(8000) * i / 129) for i in range(130)]
    db = np.zeros((len(power), 128))
    for m in range(128):
        a, b, c = edges[m : m + 3]
        w = np.array([max(0.0, min((f - a) / (b - a), (c - f) / (c - b))) for f in freq]) * 2 / (c - a)
        db[:, m] = [10 * math.log10(max(1e-10, float(p @ w))) for p in power]
    db = np.maximum(db, db.max() - 80)
    c = np.array([[sum(row[i] * math.cos(math.pi * k * (2 * i + 1) / 256) for i in range(128)) * math.sqrt((1 if k == 0 else 2) / 128) for k in range(40)] for row in db])
    score = []
    for order, scale in ((1, 30), (2, 20)):
        d = np.array([[np.polyfit(range(-4, 5), c[min(max(t, 4), len(c) - 5) - 4 :][:9, k], order)[0] * order for k in range(40)] for t in range(len(c))])
        score.append(min(100.0, d.var(axis=0).mean() / scale * 100))
    loud = [math.sqrt((f**2).mean()) for f in frames]
    peaks = sum(1 for i in range(1, len(loud) - 1) if loud[i - 1] < loud[i] > loud[i + 1])
    structure = 0.45 * score[0] + 0.3 * score[1] + 0.25 * min(100.0, peaks / max(len(x) / 16000, 0.1) / 8 * 100)
    return len(x) / 16000, min(100.0, np.mean(entropies) / math.log2(1025) * 100), min(100.0, max(0.0, snr / 40 * 100)), structure


def test_wave_measures_equal_a_plain_model(spark):
    t = np.arange(12000) / 16000
    waves = [np.sin(2 * np.pi * 440 * t) * np.abs(np.sin(9 * t)), dice.normal(size=12000) * 0.2, dice.normal(size=7000) * np.linspace(0, 1, 7000)]
    for x in waves:
        assert np.allclose(signals.wave_measures_of(x), plain_wave(x), rtol=1e-6)
    rows = [Row(i=i, wave=None if w is None else [float(v) for v in w]) for i, w in enumerate([*waves, None, [], waves[1][:300], np.tile(waves[0], 3)])]
    got = {r.i: r for r in signals.wave_measures(spark.createDataFrame(rows, "i int, wave array<float>"), "wave").collect()}
    assert got[3].entropy is None and got[4].snr is None and got[3].print is None
    assert got[5].print.startswith("0xAUD_") and got[5].structure is not None and got[6].print.startswith("0xAFP_")
    assert abs(got[0].entropy - plain_wave(waves[0])[1]) < 1e-3 and got[1].entropy > 80 > got[0].entropy


def png(p):
    """A PNG file of rows of BGR."""
    raw = b"".join(b"\0" + row[:, ::-1].tobytes() for row in p)
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", p.shape[1], p.shape[0], 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def picture(n, h=48, w=64):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([60 + 50 * np.sin(x / (3 + n) + c) + 40 * np.cos(y / (5 + n)) for c in range(3)], axis=2).astype(np.uint8)


def plain_pixels(p):
    """The measures by their definitions, pixel by pixel."""
    h, w, _ = p.shape
    entropy = 0
    for c in range(3):
        n = [0] * 256
        for v in p[:, :, c].reshape(-1):
            n[v] += 1
        entropy += -sum(k / (h * w) * math.log2(k / (h * w)) for k in n if k) / 3
    g = [[(int(r) * 19595 + int(gr) * 38470 + int(b) * 7471 + 32768) >> 16 for b, gr, r in row] for row in p]
    edges = 0
    for y in range(h):
        for x in range(w):
            v = g[y][x]
            if 0 < y < h - 1 and 0 < x < w - 1:
                v = min(255, max(0, 8 * v - sum(g[y + a][x + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)))
            edges += v > 20
    hues = set()
    for b, gr, r in p.reshape(-1, 3).astype(int):
        top, low = max(b, gr, r), min(b, gr, r)
        hue = 0 if top == low else ((gr - b) / (top - low) if r == top else 2 + (b - r) / (top - low) if gr == top else 4 + (r - gr) / (top - low)) / 6 % 1
        hues.add(int(hue * 255) // 16)
    return min(8.0, entropy), edges / (h * w), len(hues) / 16, min(1.0, h * w / 1024**2)


def test_images_by_the_jvm_decoder(spark, tmp_path):
    pictures = {"a": picture(1), "b": picture(4, 30, 90), "c": dice.integers(0, 256, (9, 7, 3)).astype(np.uint8), "d": np.full((2, 2, 3), 9, np.uint8)}
    for name, p in pictures.items():
        (tmp_path / f"{name}.png").write_bytes(png(p))
    (tmp_path / "x.png").write_bytes(b"\x89PNG no image at all")
    (tmp_path / "y.jpg").write_bytes(b"\xff\xd8 cut")
    images = containers.read_images(spark, str(tmp_path))
    got = {r.origin.rsplit("/", 1)[-1][0]: r for r in signals.pixel_measures(images, "image").collect()}
    assert set(got) == set("abcdxy") and got["x"].entropy is None and got["y"].print is None
    for name, p in pictures.items():
        r = got[name]
        assert np.allclose((r.entropy, r.edges, r.colours, r.resolution), plain_pixels(p), atol=1e-9)
        assert r.print == signals.phash(p) and r.aspect_ok == (0.5 < p.shape[1] / p.shape[0] < 2)


def test_prints_stand_a_change_of_light_and_size(spark):
    rows = []
    for n in range(6):
        p = picture(3 * n)
        for k, q in enumerate((p, np.clip(p.astype(int) + 12, 0, 255).astype(np.uint8), p.repeat(2, axis=0).repeat(2, axis=1), (p * 0.9).astype(np.uint8))):
            rows.append(Row(id=10 * n + k, kind="x", image=("", q.shape[0], q.shape[1], 3, 16, bytearray(q.tobytes()))))
    rows += [Row(id=90, kind="x", image=None), Row(id=91, kind="x", image=("", 5, 5, 3, 16, bytearray(b"short")))]
    images = spark.createDataFrame(rows, f"id int, kind string, image {containers.IMAGE}")
    prints = signals.pixel_measures(images, "image")
    first = {r.id: r.earlier for r in joins.hamming_first(prints, "id", F.col("print"), ["kind"]).collect()}
    assert all(first.get(10 * n + k) == 10 * n for n in range(6) for k in (1, 2, 3)) and all(first[10 * n] is None for n in range(6))


def test_films(spark):
    side, pause = 18, 250_000
    pictures = [picture(n % 7, side, side) for n in range(90)]
    sound = (np.sin(np.arange(8000 * 2) / 8000 * 2 * np.pi * 440) * 100 + 128).astype(np.uint8).tobytes()
    body = film(pictures, side, pause, sound)
    assert [f["place"] for f in containers.frames_of(body)] == [int(i * 89 / 15) for i in range(16)]
    assert len(containers.frames_of(film(pictures[:13], side, pause))) == 3 and containers.frames_of(film(pictures[:3], side, pause))[0]["place"] == 1
    rows = [Row(id=1, payload=bytearray(body)), Row(id=2, payload=bytearray(film(pictures, side, pause, sound, up=False))), Row(id=3, payload=bytearray(b"no film")), Row(id=4, payload=None), Row(id=5, payload=bytearray(body[:3000]))]
    df = spark.createDataFrame(rows, "id int, payload binary")
    frames = containers.frames(df, "id", "payload").cache()
    for r in frames.where("id < 3").collect():
        assert bytes(r.image.data) == pictures[r.place].tobytes() and r.at == r.place * 0.25
    assert {r.id for r in frames.select("id").distinct().collect()} == {1, 2, 5}
    prints = {r.id: r for r in signals.film_prints(signals.pixel_measures(frames.drop("bytes"), "image"), "id").collect()}
    assert prints[1].code == prints[2].code and prints[1].print == prints[2].print and len(prints[1].code) == 16
    own = [signals.phash(pictures[f["place"]]) for f in containers.frames_of(body)]
    most = sum(1 << i for i in range(64) if sum((v >> i & 1) * 2 - 1 for v in own) > 0)
    assert prints[1].print == most - (1 << 64) * (most >> 63)
    waves = {r.id: r.wave for r in containers.waves(df, "id", "payload").collect()}
    assert len(waves[1]) == 2 * 16000 and np.allclose(waves[1], containers.wave_of(wav(sound, 8000, bits=8)), atol=1e-6) and waves[3] is None and waves[4] is None


def test_payloads_tell_their_kind(spark):
    known = {"wav": wav(b"", 8000), "avi": film([picture(1, 4, 4)], 4, 1), "webm": b"\x1a\x45\xdf\xa3..", "png": png(picture(1)), "mp4": b"\0\0\0\x18ftypisom", None: b"plain", "jpeg": b"\xff\xd8\xff\xe0"}
    rows = [Row(want=k, uri="data:x/y;base64," + base64.b64encode(v).decode()) for k, v in known.items()] + [Row(want=None, uri="data:x/y;base64,***"), Row(want=None, uri=None)]
    for r in containers.payloads(spark.createDataFrame(rows, "want string, uri string"), "uri").collect():
        assert r.kind == r.want
    made = spark.range(1).select(containers.wav_payload(F.lit(b"abcd"), 8000).alias("w"), containers.film_payload(F.lit(bytes(range(200)) * 10), 8).alias("f")).first()
    assert np.allclose(containers.wave_of(bytes(made.w))[::2], (np.frombuffer(b"abcd", np.uint8) - 128.0) / 128, atol=0.3)
    assert len(containers._film(memoryview(bytes(made.f)))[1]) == 11


def test_waves_measured_together_equal_each_alone():
    waves = [dice.normal(size=n) * 0.2 for n in (1, 511, 512, 3000, 4095, 4096, 12000, 512 * 300, 5000)] + [np.zeros(6000), np.tile(dice.normal(size=1000), 9)]
    waves[4][7] = np.nan  # spoils no other wave's measures
    for x, got in zip(waves, signals.measured(waves), strict=True):
        assert np.allclose(got, signals.wave_measures_of(x), rtol=1e-9, equal_nan=True)
    for n in (9, 40, 41):
        x = dice.random(n)
        assert np.isclose(signals._percentile(x, 0.15), np.percentile(x, 15), rtol=1e-12)
    some = signals._waves_measured(iter([waves[3], None, np.zeros(0), waves[7], waves[8]]))
    assert some[1] is some[2] is None and [r[0] for r in some if r] == [3000 / 16000, 512 * 300 / 16000, 5000 / 16000]


def test_payloads_are_decoded_and_measured_in_one_python_step(spark):
    files = [Row(i=i, payload=p) for i, p in enumerate([wav(bytes(dice.integers(0, 256, n).astype(np.uint8)), 8000, bits=8) for n in (100, 3000, 9000)] + [None, b"none", wav(b"", 8000, bits=8)])]
    df = spark.createDataFrame(files, "i int, payload binary")
    one, two = signals.payload_measures(df, "payload"), signals.wave_measures(containers.waves(df, "i", "payload"), "wave")
    assert one.sort("i").collect() == two.sort("i").collect()
    query = plans.wave_measures(spark.createDataFrame([(1, "text")], "doc_id long, text string"))
    assert query._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
