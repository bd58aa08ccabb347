"""Golden bytes, inverse laws and round trips of codecs, ciphers and generators."""

import datetime
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vaultlens.codecs import ciphers, gale, jpeg, lz, png, prng, program, tlg
from vaultlens.codecs.errors import MalformedError
from vaultlens.functions.dos_time import dos_decode, dos_encode

RNG = np.random.default_rng(0)
BLOCK = [~(0x12345678 + i * 0x9ABCDEF0) & 0xFFFFFFFF for i in range(1024)]


def test_marker_lz_golden():
    assert lz.marker_decode(bytes.fromhex("41FFFF42")) == b"A\xffB"
    assert lz.marker_decode(b"ABCD\xff\x0c") == b"ABCDABC"
    assert lz.marker_decode(b"A\xff\x03") == b"A" * 7
    assert lz.marker_decode(b"A\xff") == b"A"
    assert lz.marker_encode(b"\xff") == b"\xff\xff"
    with pytest.raises(MalformedError):
        lz.marker_decode(b"A\xff\x08")


@given(st.binary(max_size=300) | st.lists(st.sampled_from(b"ab\xff"), max_size=400).map(bytes))
@settings(max_examples=60, deadline=None)
def test_lz_round_trips(data):
    assert lz.marker_decode(lz.marker_encode(data)) == data
    assert lz.marker_decode(lz.marker_store(data)) == data
    assert lz.sized_lzss_decode(lz.sized_lzss_encode(data)) == data
    assert lz.ImageRing().decode(lz.image_encode(data), len(data)) == data


def test_marker_lz_never_uses_the_escape_as_a_code():
    data = b"abcdef" + bytes(range(100, 158)) + b"abcdef"
    packed = lz.marker_encode(data)
    assert lz.marker_decode(packed) == data and len(packed) < len(data)


def test_ring_lzss_golden():
    assert lz.sized_lzss_decode(b"\5\0\0\0\7ABC\0\x10") == b"ABCAB"
    assert lz.sized_lzss_decode(b"\5\0\0\0\7XYZ\xff\xf0") == b"XYZ\0\0"
    assert lz.sized_lzss_decode(b"\6\0\0\0\1A\0\x13") == b"AAAAAA"
    with pytest.raises(MalformedError):
        lz.sized_lzss_decode(b"\6\0\0\0\1A")


def test_ciphers_golden():
    assert ciphers.script_decrypt(b"\x58") == b"\x16"
    assert ciphers.hash_xor(b"\0\xff\x1f\xa0", 0b11111000, 3) == bytes(x ^ 0x1F for x in b"\0\xff\x1f\xa0")
    assert ciphers.fixed_xor(bytes.fromhex("10203040"), "0102") == bytes.fromhex("11223142")
    assert ciphers.successor_xor(b"\0\xff\xfe\xa0", 0) == bytes(x ^ 0xFE for x in b"\0\xff\xfe\xa0")
    assert ciphers.spin_decrypt(bytes.fromhex("A5FF0180")) == bytes.fromhex("5AFF0201")
    for bad in ("", "0x", b""):
        with pytest.raises(MalformedError):
            ciphers.fixed_xor(b"a", bad)


@pytest.mark.parametrize("name", [n for n in ciphers.CIPHERS])
def test_ciphers_invert(name):
    parameters = {"fixed-xor": {"key": "a1b2c3"}, "hash-xor": {"shift": 5}, "cxcrypt": {"control_block": BLOCK, "mask": 0x1C9, "offset": 0x1F3}}.get(name, {})
    data = bytes(range(256)) * 9
    for key in (0, 1, 0xDEADBEEF):
        packed = ciphers.apply_cipher(data, key, name, parameters, encrypt=True)
        assert ciphers.apply_cipher(packed, key, name, parameters) == data
        assert ciphers.apply_cipher(b"", key, name, parameters) == b""


@pytest.mark.parametrize("key", range(8))
@pytest.mark.parametrize("shuffle", range(4))
def test_keyed_scripts(key, shuffle):
    head = bytes([0xF0 + key, 0xF0 + shuffle, 0, 0])
    data = head + bytes(range(256)) + b"an odd tail.."
    assert ciphers.keyed_script(ciphers.keyed_script(data, True)) == data
    assert ciphers.keyed_script(head + b"\xff" * 16) == head + bytes(16)
    assert ciphers.keyed_script(b"abc") == b"abc" and ciphers.keyed_script(b"plain text") == b"plain text"


def test_framed_text():
    text = "﻿words é".encode("utf-16-le")
    for mode in (1, 2):
        assert ciphers.text_decode(ciphers.text_encode(text, mode)) == text
    assert ciphers.text_encode(b"\xff\xfe") == b"\xfe\xfe\x01\xff\xfe"
    low = "\x01\x1f".encode("utf-16-le")
    assert ciphers.text_decode(b"\xfe\xfe\x00\xff\xfe" + low) == b"\xff\xfe" + low
    assert ciphers.text_decode(text) == text and ciphers.text_decode(b"plain") == b"plain"
    for bad in (b"\xfe\xfe", b"\xfe\xfe\x03\xff\xfe", b"\xfe\xfe\x01ab", b"\xfe\xfe\x01\xff\xfea", b"\xfe\xfe\x02\xff\xfeshort"):
        with pytest.raises(MalformedError):
            ciphers.text_decode(bad)


def test_mask_stream():
    assert prng.mask_state(1) == 0x75D6EE39 and prng.mask_state(2) == 6 * 0x75D6EE39 & 0xFFFFFFFF
    state, seen = 0, []
    for _ in range(100):
        state = 5 * state + 77 & 0xFFFFFFFF
        seen.append(state)
    assert prng.mask_states(1, 100, 77).tolist() == seen and prng.mask_states(41, 60, 77).tolist() == seen[40:]
    assert prng.mask_bytes(bytes.fromhex("0966D78CD5828389FF22CC96"), 1) == b"00000001.lsb"


@pytest.mark.parametrize("size", [4, 16, 64, 256])
@pytest.mark.parametrize("seed", [0, 1, 0xDEADBEEF, 0xF8EA])
def test_scramble(size, seed):
    for data in (bytes(range(256)) * 4, b"", b"abc", bytes(range(97))):
        assert prng.unscramble(prng.scramble(data, size, seed)) == data
    with pytest.raises(MalformedError):
        prng.unscramble(b"short")


@pytest.mark.parametrize("count", [1, 2, 5, 16, 100])
def test_chunk_order_keeps_the_last(count):
    order = prng.chunk_order(count, 77)
    assert sorted(order) == list(range(count)) and order[-1] == count - 1


def test_programs():
    assert prng.program_lcg(0)() == 12345
    data = RNG.bytes(4000)
    for kind in ("lcg", "nana"):
        for key in (0, 1, 0x80000000, 0xDEADBEEF):
            packed = program.program_xor(data, key, BLOCK, 0x1C9, 0x1F3, prng_type=kind, random_seed=9)
            assert packed != data and program.program_xor(packed, key, BLOCK, 0x1C9, 0x1F3, prng_type=kind, random_seed=9) == data
    assert program.control_block(program.make_plugin(BLOCK, b"xx"))[7:] == tuple(BLOCK[7:])
    assert program.control_block(b"nothing") is None


def test_program_stack_is_balanced_for_every_seed():
    orders = program.Generator((0, 1, 2), tuple(range(6)), tuple(range(8)))
    for seed in range(128):
        p = orders.program(prng.program_lcg(seed))
        assert p.size <= program.CODE_LIMIT
        p.run(12345, tuple(BLOCK))


def pictures():
    for w, h in ((4, 4), (17, 9), (8, 8), (1, 1), (20, 25)):
        noise = RNG.integers(0, 256, (h, w, 4), dtype=np.uint8)
        smooth = np.cumsum(RNG.integers(-2, 3, (h, w, 4)), axis=1).astype(np.uint8)
        for image in (noise, smooth, noise * 0):
            yield w, h, image


@pytest.mark.parametrize("channels", [3, 4])
def test_layered_graphics(channels):
    for w, h, image in pictures():
        if channels == 3:
            image = image.copy()
            image[:, :, 3] = 255
        raw = image.tobytes()
        for plain in (False, True):
            assert tlg.decode(tlg.encode_strips(w, h, raw, channels, 4, plain)) == (w, h, raw)
        filters = RNG.integers(0, 32, (-(-h // 8), -(-w // 8)), dtype=np.uint8)
        assert tlg.decode(tlg.wrap(tlg.encode_blocks(w, h, raw, channels, filters))) == (w, h, raw)
    for bad in (b"", b"TLG9.9\0raw\x1a", tlg.STRIPS + b"\x04", tlg.STRIPS + bytes([5]) + bytes(12), tlg.BLOCKS + b"\x04\0"):
        with pytest.raises(MalformedError):
            tlg.decode(bad)


def test_tags():
    text = "4:LEFT=2:20,3:TOP=3:120,"
    assert tlg.tags_by_length(text) == [("LEFT", "20"), ("TOP", "120")]
    assert tlg.tags_by_split(text) == {"LEFT": "20", "TOP": "120"}
    assert tlg.tags_by_length("x:bad") == [] and tlg.tags_by_split("bad,4:LEFT=2:20") == {"LEFT": "20"}
    assert tlg.metadata_chunks(tlg.wrap(b"x" * 12, [(b"tags", b"ab")])[11:]) == [(b"tags", b"ab")]


def test_layer_images():
    rows = bytes([0, 0, 255, 0, 255, 0, 0, 0, 255, 0, 0, 255, 255, 255, 0, 0])  # 2 x 2, BGR, padded to 8
    assert gale.decode(gale.encode(2, 2, 24, rows)) == (2, 2, "RGB", bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 255, 255, 255]))
    alpha = bytes([1, 2, 0, 0, 3, 4, 0, 0])
    for version in (103, 107):
        for compression in (0, 1):
            w, h, mode, pixels = gale.decode(gale.encode(2, 2, 24, rows, alpha, version, compression=compression))
            assert mode == "RGBA" and pixels[3::4] == b"\1\2\3\4"
    palette = b"".join(bytes([i, 2 * i, 3 * i, 0]) for i in range(16))
    assert gale.decode(gale.encode(3, 1, 4, b"\x21\x03", palette=palette))[3] == bytes([3, 2, 1, 6, 4, 2, 9, 6, 3])
    assert gale.decode(gale.encode(1, 1, 16, b"\x00\xf8\0\0"))[3] == b"\xff\0\0"
    tall = RNG.bytes(40)
    shuffled = gale.encode(2, 5, 24, tall, key=99)
    assert gale.decode(shuffled, 99) == gale.decode(gale.encode(2, 5, 24, tall))
    with pytest.raises(gale.UnsupportedError):
        gale.decode(shuffled)
    with pytest.raises(MalformedError):
        gale.decode(gale.encode(2, 2, 24, rows, compression=2))
    assert gale.decode(gale.encode(1, 1, 24, b"jpg", compression=2), jpeg=lambda d: (3, b"\1\2\3"))[3] == b"\3\2\1"
    for bad in (b"Gale", b"Gale1x5" + bytes(60), b"Gale105" + (9).to_bytes(4, "little") + bytes(60)):
        with pytest.raises(MalformedError):
            gale.decode(bad)


def test_layer_image_blocks():
    head = gale.encode(4, 2, 8, bytes(8), palette=b"".join(bytes([i, i, i, 0]) for i in range(256)))
    at = 11
    body = bytearray(head)
    body[at + 0x1C : at + 0x24] = (2).to_bytes(4, "little") * 2
    refs = np.array([-1, 0, -2, 0], "<i4").tobytes() + b"\1\2\3\4"
    start = len(head) - 8 - len(zlib.compress(bytes(8))) + 4
    plane = zlib.compress(refs)
    data = bytes(body[: start - 4]) + len(plane).to_bytes(4, "little") + plane + bytes(4)
    w, h, mode, pixels = gale.decode(data)
    assert pixels[::3] == bytes([1, 2, 1, 2, 3, 4, 3, 4])


def test_xml_layer_image():
    xml = b'<Frames Version="200" Width="1" Height="1" Bpp="24" Count="1" CompType="0" BlockWidth="0" BlockHeight="0"><Frame a="1" a="2"><Layers Width="1" Height="1" Bpp="24"><Layer AlphaOn="1"/></Layers></Frame></Frames>'
    head, plane, alpha = (zlib.compress(x) for x in (xml, b"\1\2\3\0", b"\x09\0\0\0"))
    data = b"GaleX200" + len(head).to_bytes(4, "little") + head + len(plane).to_bytes(4, "little") + plane + len(alpha).to_bytes(4, "little") + alpha
    assert gale.decode(data) == (1, 1, "RGBA", b"\3\2\1\x09")
    assert gale.xml_palette("0102030405", 4)[:2] == [(1, 2, 3), (0, 0, 0)]


def jvm_jpeg(spark, image, grey=False):
    """A picture as JPEG, and what the JVM decodes it to."""
    jvm = spark.sparkContext._jvm
    h, w = image.shape[:2]
    kind = jvm.java.awt.image.BufferedImage
    picture = kind(w, h, kind.TYPE_BYTE_GRAY if grey else kind.TYPE_INT_RGB)
    for y in range(h):
        for x in range(w):
            r, g, b = (int(v) for v in image[y, x])
            picture.setRGB(x, y, r << 16 | g << 8 | b)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(picture, "jpg", out)
    raw = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(raw))
    seen = np.array([[[v >> 16 & 255, v >> 8 & 255, v & 255] for v in (back.getRGB(x, y) for x in range(w))] for y in range(h)])
    return raw, seen


@pytest.mark.parametrize(("w", "h"), [(8, 8), (37, 21), (16, 40)])
def test_jpeg(spark, w, h):
    y, x = np.mgrid[:h, :w]
    image = np.stack([x * 255 // w, y * 255 // h, 255 - x * 255 // w], 2)
    raw, seen = jvm_jpeg(spark, image)
    width, height, channels, samples = jpeg.decode(raw)
    got = np.frombuffer(samples, np.uint8).reshape(h, w, 3).astype(int)
    assert (width, height, channels) == (w, h, 3) and np.abs(got - seen).mean() < 4 and np.abs(got - image).mean() < 8
    bgr = gale.decode(gale.encode(w, h, 24, raw, compression=2))
    assert bgr[:3] == (w, h, "RGB") and np.array_equal(np.frombuffer(bgr[3], np.uint8), got.ravel())
    raw, seen = jvm_jpeg(spark, np.repeat(image[:, :, :1], 3, 2), grey=True)
    assert jpeg.decode(raw)[2] == 1
    for bad in (b"", raw[:40], raw[: len(raw) // 2], raw.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(MalformedError):
            jpeg.decode(bad)


def test_png():
    assert png.decode(png.encode(2, 2, "RGBA", bytes(range(16)))) == (2, 2, "RGBA", bytes(range(16)))
    assert png.decode(png.encode(1, 2, "RGB", b"abcdef")) == (1, 2, "RGB", b"abcdef")


def test_dos_time():
    ts = datetime.datetime(2005, 10, 25, 23, 49, 14)
    assert dos_encode(ts) == 0x3359BE27 and dos_decode(0x3359BE27) == ts
    assert dos_encode(ts.replace(second=15)) == 0x3359BE27 and dos_decode(0) is None
    with pytest.raises(ValueError):
        dos_encode(ts.replace(year=1979))
