"""Column functions over binary columns: Arrow-batched codecs and ciphers, and built-in hashes.

A codec that meets malformed bytes gives null; ``strict=True`` raises instead.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, LongType, StringType

from vaultlens.codecs import ciphers, gale, lz, png, prng, tlg
from vaultlens.codecs.errors import MalformedError

IMAGE = "struct<codec:string,width:int,height:int,mode:string,pixels:binary,error:string>"


def values(column: pa.Array) -> Iterator:
    """The values of a batch one by one, so that it isn't held a second time as Python objects."""
    return (v.as_py() for v in column)


def binary_array(parts: Iterable[bytes | None]) -> pa.Array:
    """A binary array of values as they come; each is copied to its place at once and let go."""
    data, ends, valid = bytearray(), array("i", [0]), bytearray()
    for part in parts:
        valid.append(part is not None)
        if part is not None:
            data += part
        ends.append(len(data))
    nulls = None if all(valid) else pa.array(np.packbits(np.frombuffer(valid, np.uint8), bitorder="little")).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(valid), [nulls, pa.py_buffer(ends), pa.py_buffer(data)])


def byte_function(function: Callable[..., bytes], *, strict: bool = False) -> Callable[..., Column]:
    """A column function from a function of bytes and further row values; null in, null out."""

    def one(*row) -> bytes | None:
        try:
            return None if row[0] is None else function(*row)
        except (MalformedError, zlib.error, IndexError):
            if strict:
                raise
            return None

    @arrow_udf(BinaryType())
    def run(*columns: pa.Array) -> pa.Array:
        return binary_array(map(one, *map(values, columns)))

    return run


lz77_decode, lz77_store, lz77_encode = map(byte_function, (lz.marker_decode, lz.marker_store, lz.marker_encode))
lzss_decode = byte_function(lz.sized_lzss_decode)
inflate, deflate = byte_function(zlib.decompress), byte_function(zlib.compress)
unscramble = byte_function(prng.unscramble)
text_decode, text_encode = byte_function(ciphers.text_decode), byte_function(ciphers.text_encode)
keyed_decrypt, keyed_encrypt = byte_function(ciphers.keyed_script), byte_function(lambda d: ciphers.keyed_script(d, True))
spin_decrypt, spin_encrypt = byte_function(ciphers.spin_decrypt), byte_function(ciphers.spin_encrypt)
script_decrypt, script_encrypt = byte_function(ciphers.script_decrypt), byte_function(ciphers.script_encrypt)
swap_pairs = byte_function(ciphers.swap_pairs)
successor_xor = byte_function(ciphers.successor_xor)
mask_names = byte_function(prng.mask_bytes)


def scramble(data: Column, size: int, raw_seed: int = 0) -> Column:
    return byte_function(lambda d: prng.scramble(d, size, raw_seed))(data)


def hash_xor(data: Column, key: Column, shift: int) -> Column:
    return byte_function(lambda d, k: ciphers.hash_xor(d, k, shift))(data, key)


def fixed_xor(data: Column, key: bytes | str) -> Column:
    return byte_function(lambda d: ciphers.fixed_xor(d, key))(data)


def cipher(data: Column, key: Column, name: str, parameters: dict | None = None, encrypt: bool = False) -> Column:
    return byte_function(lambda d, k: ciphers.apply_cipher(d, k, name, parameters, encrypt))(data, key)


@arrow_udf(LongType())
def adler32(data: pa.Array) -> pa.Array:
    return pa.array([None if d is None else zlib.adler32(d) for d in values(data)], pa.int64())


def charset_decode(data: Column, charset: str) -> Column:
    """Text in a charset that Spark lacks, as shift_jis and cp932; null where it isn't."""

    @arrow_udf(StringType())
    def run(data: pa.Array) -> pa.Array:
        out = []
        for d in values(data):
            try:
                out.append(None if d is None else d.decode(charset))
            except UnicodeDecodeError:
                out.append(None)
        return pa.array(out, pa.string())

    return run(data)


def decode_image(data: bytes, key: int = 0) -> dict:
    """IMAGE of a member: layered-graphics or layer-based by magic; error says why there are no pixels."""
    try:
        if data[:4] == gale.PREFIX:
            width, height, mode, pixels = gale.decode(data, key)
            return dict(codec="gale", width=width, height=height, mode=mode, pixels=pixels, error=None)
        width, height, pixels = tlg.decode(data)
        return dict(codec="tlg", width=width, height=height, mode="RGBA", pixels=pixels, error=None)
    except MalformedError as e:
        return dict(codec=None, width=None, height=None, mode=None, pixels=None, error=str(e))


def image(data: Column, key: int = 0) -> Column:
    @arrow_udf(IMAGE)
    def run(data: pa.Array) -> pa.Array:
        kind = pa.struct([("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("mode", pa.string()), ("pixels", pa.binary()), ("error", pa.string())])
        return pa.array([None if d is None else decode_image(d, key) for d in values(data)], kind)

    return run(data)


@arrow_udf(BinaryType())
def png_encode(images: pa.Array) -> pa.Array:
    return binary_array(None if i is None or i["pixels"] is None else png.encode(i["width"], i["height"], i["mode"], i["pixels"]) for i in values(images))


# --- built-in functions ------------------------------------------------------------


def little_endian(data: Column, at: Column | int, size: int) -> Column:
    """An unsigned number of size bytes at a place counted from 0; null past the end."""
    part = F.substring(data, (at if isinstance(at, Column) else F.lit(at)) + 1, F.lit(size))
    return F.when(F.octet_length(part) == size, F.conv(F.hex(F.reverse(part)), 16, 10).cast("long"))


def content_sha256(data: Column) -> Column:
    return F.sha2(data, 256)


def slug(text: Column) -> Column:
    """Lower case with hyphens; eight hex digits of the MD5 where there is more than ASCII."""
    plain = F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_\s-]", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"[\s_]+", "-"), r"^-+|-+$", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.substring(F.md5(text), 1, 8)).when(plain == "", "unknown").otherwise(plain)


def tag_map(text: Column) -> Column:
    """``length:name=length:value`` items by their commas; items that lack a sign are left out."""
    items = F.filter(F.transform(F.split(text, ","), lambda i: F.trim(i)), lambda i: i.rlike(r"^[^=:]*:[^=]*=[^:]*:"))
    name = lambda i: F.regexp_extract(i, r"^[^:=]*:([^=]*)=", 1)
    value = lambda i: F.regexp_extract(i, r"^[^=]*=[^:]*:((?s).*)$", 1)
    return F.map_from_entries(F.transform(items, lambda i: F.struct(name(i).alias("key"), value(i).alias("value"))))


#: Hash to key byte, and the scheme that each stands for.
KEY_FORMULAS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    **{f"h >> {s}": (f"hash-xor shift={s}", lambda h, s=s: F.shiftright(h, s)) for s in (*range(9), 16, 24)},
    "~(h + 1)": ("successor", lambda h: F.bitwise_not(h + 1)),
    "h ^ cd": ("constant", lambda h: h.bitwiseXOR(F.lit(0xCD))),
    "h ^ h >> 8": ("fold", lambda h: h.bitwiseXOR(F.shiftright(h, 8))),
    "~(h >> 7)": ("inverse", lambda h: F.bitwise_not(F.shiftright(h, 7))),
    "bytes of h ^ 1ddb6e7a": ("bytes", lambda h: _folded(h.bitwiseXOR(F.lit(0x1DDB6E7A)))),
}


def _folded(h: Column) -> Column:
    k = h.bitwiseXOR(F.shiftright(h, 8)).bitwiseXOR(F.shiftright(h, 16)).bitwiseXOR(F.shiftright(h, 24)).bitwiseAND(0xFF)
    return F.when(k == 0, 0xD0).otherwise(k)


def key_formulas(h: Column) -> Column:
    """array<struct<formula, scheme, key>> of every formula's key byte for the hash."""
    h = h.cast("long")
    return F.array(*(F.struct(F.lit(f).alias("formula"), F.lit(s).alias("scheme"), k(h).bitwiseAND(0xFF).cast("long").alias("key")) for f, (s, k) in KEY_FORMULAS.items()))
