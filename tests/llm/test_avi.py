import struct
import zlib
from hashlib import sha256

import numpy as np

from loamworks.llm import avi
from loamworks.session import read_table

from ..conftest import SF


def huffman(symbols):
    """A table of codes of growing length, and symbol to (length, code)."""
    counts, codes, code = [0] * 16, {}, 0
    for length, s in enumerate(symbols, 1):
        counts[length - 1] = 1
        codes[s] = (length, code)
        code = (code + 1) << 1
    return bytes(counts) + bytes(symbols), codes


def jpeg(blocks, every=0, ones=200):
    """A grey baseline JPEG, 8 lines high, of blocks of (DC, {place: AC}), by the definition."""
    dc, dc_codes = huffman(list(range(12)))
    ac, ac_codes = huffman([0x00, 0x01, 0x05, 0x08, 0x13, 0xF0, 0xF1, 0xC1])
    bits, last, scan = "", 0, b""

    def extra(v):
        n = abs(v).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def flush():
        nonlocal bits, scan
        bits += "1" * (-len(bits) % 8)
        scan += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
        bits = ""

    for i, (d, values) in enumerate(blocks):
        if every and i and i % every == 0:
            flush()
            scan += bytes([0xFF, 0xD0 + (i // every - 1) % 8])
            last = 0
        n, e = extra(d - last)
        last = d
        bits += format(dc_codes[n][1], f"0{dc_codes[n][0]}b") + e
        k = 1
        for place in sorted(values):
            while place - k >= 16:
                bits += format(ac_codes[0xF0][1], f"0{ac_codes[0xF0][0]}b")
                k += 16
            n, e = extra(values[place])
            s = (place - k) << 4 | n
            bits += format(ac_codes[s][1], f"0{ac_codes[s][0]}b") + e
            k = place + 1
        if k < 64:
            bits += format(ac_codes[0][1], f"0{ac_codes[0][0]}b")
    flush()
    seg = avi._segment
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + bytes([2] * 64)) + seg(0xC0, struct.pack(">BHHB", 8, 8, 8 * len(blocks), 1) + bytes([1, 0x11, 0]))
    head += seg(0xC4, b"\0" + dc + b"\x10" + ac) + (seg(0xDD, struct.pack(">H", every)) if every else b"") + seg(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    return head + scan + b"\xff\xd9"


def test_general_frames_are_decoded():
    blocks = [(5, {1: 20, 2: -31}), (-200, {1: 1, 17: -1, 19: 7}), (900, {}), (-900, {63: 1, 62: -1, 1: -17}), (0, {k: 200 for k in range(1, 64)})]
    want = np.zeros((5, 64), int)
    for i, (d, values) in enumerate(blocks):
        want[i, 0] = d
        for k, v in values.items():
            want[i, k] = v
    for every in (0, 1, 2):
        got, owner, quant = avi.coefficients(jpeg(blocks, every))
        assert np.array_equal(got.reshape(5, 64), want) and owner == [1] and set(quant[1]) == {2}
    flat = avi.luma_histogram(avi.coefficients(jpeg([(4 * (60 - 128), {})] * 3)))
    assert flat[60 // 8] == 1


def movie(images):
    frames = b"".join(avi._chunk(b"00dc", f) for f in images)
    return avi._chunk(b"RIFF", b"AVI " + avi._chunk(b"LIST", b"hdrl" + avi._chunk(b"avih", struct.pack("<14I", 100_000, *[0] * 13))) + avi._chunk(b"LIST", b"movi" + frames))


def test_payloads_come_back_whole():
    rng = np.random.default_rng(5)
    for n in (192, 192 * 16, 192 * 17, 192 * 100):
        for payload in (rng.integers(0, 256, n, np.uint8).tobytes(), b"\xff" * n, b" " * n, b"\0" * n):
            file = avi.store(payload)
            got, cuts, seconds = avi.read(file)
            assert got == payload and cuts[-1][1] == -(-n // (192 * 16)) and seconds == 0.04


def test_fast_way_equals_bits(monkeypatch):
    image = avi._still(np.random.default_rng(1).integers(0, 255, (3, 192), np.uint8))
    fast = avi.coefficients(image)[0]
    monkeypatch.setattr(avi, "_runs", lambda scan, f=avi._runs: [r + b"\0" for r in f(scan)])
    assert np.array_equal(avi.coefficients(image)[0], fast)


def test_shots_and_clip_rows(spark):
    dark, light = jpeg([(4 * (40 - 128), {})] * 4), jpeg([(4 * (220 - 128), {})] * 4, 2)
    film = movie([dark] * 5 + [light] * 4 + [dark] * 3)
    media = spark.createDataFrame([(1, film, "x"), (1, film, "x"), (2, b"junk", "x"), (3, None, "x"), (4, movie([]), "x"), (5, film[:700], "x")], "doc_id long, media binary, clip string")
    rows = [r for r in avi.clips(media).collect()]
    one = sorted((r.clip, r.start_s, r.end_s, r.n_frames) for r in rows if r.doc_id == 1)
    assert one == sorted([(0, 0.0, 0.5, 5), (1, 0.5, 0.9, 4), (2, 0.9, 1.2, 3)] * 2)
    assert {r.doc_id for r in rows if r.error} >= {2, 3} and not [r for r in rows if r.doc_id == 4]


def test_digest(spark):
    texts = [r.text for r in read_table(spark, SF, "documents").collect()][:60] + [None, "", "é" * 96, "x" * 193, "y " * 30000, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in avi.digest(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(avi.store(payload)), sha256(avi.store(payload)).hexdigest())
    assert got[61][1:] == got[65][1:] and avi.digest(docs.limit(0)).count() == 0


def photo(spark, width, height):
    """A colour JPEG of the JVM's own writer, which uses the usual Huffman tables."""
    jvm, rng = spark._jvm, np.random.default_rng(3)
    image = jvm.java.awt.image.BufferedImage(width, height, 1)
    shades = np.clip(rng.normal(128, 60, (height, width, 3)).cumsum(axis=1) / 8 % 256, 0, 255).astype(int)
    for y in range(height):
        for x in range(width):
            r, g, b = map(int, shades[y, x])
            image.setRGB(x, y, r << 16 | g << 8 | b)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


def without_tables(image):
    """The image less its Huffman tables, and these by slot."""
    at, out, tables = 2, image[:2], {}
    while image[at + 1] != 0xDA:
        size = struct.unpack_from(">H", image, at + 2)[0]
        if image[at + 1] == 0xC4:
            body = image[at + 4 : at + 2 + size]
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]], body = body[1:n], body[n:]
        else:
            out += image[at : at + 2 + size]
        at += 2 + size
    return out + image[at:], tables


def test_frames_without_tables_mean_the_usual_ones(spark):
    image = photo(spark, 40, 24)
    bare, tables = without_tables(image)
    assert set(tables) == {0x00, 0x01, 0x10, 0x11} and all(avi._usual(slot) == t for slot, t in tables.items())
    want, owner, _ = avi.coefficients(image)
    got, same, _ = avi.coefficients(bare)
    assert np.array_equal(got, want) and same == owner and np.abs(want).sum() > 0
    rows = avi.clips(spark.createDataFrame([(1, movie([bare] * 3))], "doc_id long, media binary")).collect()
    assert [(r.n_frames, r.error) for r in rows] == [(3, None)]


def test_index_of_indexes_over_several_lists():
    dark, light, lost = (jpeg([(4 * (v - 128), {})] * 3) for v in (40, 220, 90))

    def file(super_index, index_of):
        header = avi._chunk(b"LIST", b"hdrl" + avi._chunk(b"avih", struct.pack("<14I", 100_000, *[0] * 13)) + avi._chunk(b"LIST", b"strl" + avi._chunk(b"indx", super_index)))
        first = avi._chunk(b"RIFF", b"AVI " + header + avi._chunk(b"LIST", b"movi" + avi._chunk(b"00dc", lost) + avi._chunk(b"00dc", dark) + index_of(0)) + avi._chunk(b"idx1", struct.pack("<4sIII", b"00dc", 16, 4, len(lost))))
        return first + avi._chunk(b"RIFF", b"AVIX" + avi._chunk(b"LIST", b"movi" + avi._chunk(b"00dc", light) + avi._chunk(b"00dc", dark) + index_of(1)))

    plain = file(bytes(24 + 32), lambda i: avi._chunk(b"ix00", bytes(24 + 8 * (i + 1))))
    at = [plain.index(x, start) for x, start in ((dark, 0), (light, 0), (dark, plain.index(light)))]
    named = [[at[0]], at[1:]]

    def index_of(i):
        places = b"".join(struct.pack("<II", a - 100, len(light if a == at[1] else dark) | 0x80000000) for a in named[i])
        return avi._chunk(b"ix00", struct.pack("<HBBI4sQI", 2, 0, 1, len(named[i]), b"00dc", 100, 0) + places)

    lists = [plain.index(b"ix00"), plain.rindex(b"ix00")]
    whole = struct.pack("<HBBI4s12x", 4, 0, 0, 2, b"00dc") + b"".join(struct.pack("<QII", a, len(index_of(i)), 1) for i, a in enumerate(lists))
    media = file(whole, index_of)
    assert len(media) == len(plain)
    images, seconds = avi.frames(media)
    assert images == [dark, light, dark] and seconds == 0.1  # one frame is in no new index
    assert avi.frames(movie([dark, light]))[0] == [dark, light]


def test_odd_files_give_an_error_row_each(spark):
    small = jpeg([(5, {})] * 2)
    huge = small.replace(struct.pack(">BHHB", 8, 8, 16, 1), struct.pack(">BHHB", 8, 65535, 65535, 1))
    nested = b""
    for _ in range(3000):
        nested = avi._chunk(b"LIST", b"rec " + nested)
    deep = avi._chunk(b"RIFF", b"AVI " + nested)
    media = spark.createDataFrame([(1, movie([huge])), (2, deep), (3, b""), (4, movie([small]))], "doc_id long, media binary")
    rows = {r.doc_id: r for r in avi.clips(media).collect()}
    assert rows[1].error == "the frame ends early" and rows[3].error and rows[4].n_frames == 1 and 2 not in rows


def test_a_long_interval_is_read_in_linear_time():
    blocks = [(i % 50, {1: 1}) for i in range(8_000)]
    got = avi.coefficients(jpeg(blocks))[0].reshape(-1, 64)  # bit by bit over the whole interval it took minutes
    assert got[:, 0].tolist() == [d for d, _ in blocks] and (got[:, 1:] != 0).sum() == 8_000
