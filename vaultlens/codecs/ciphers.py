"""Byte ciphers of archive members: maps of single bytes, key streams, and two text framings.

Each cipher of the registry takes (data, key, parameters) and gives bytes; key
is the entry's 32-bit checksum.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from vaultlens.codecs.errors import MalformedError

BYTES = np.arange(256, dtype=np.uint8)


def rotate_left(b: np.ndarray, by: np.ndarray | int) -> np.ndarray:
    wide = b.astype(np.uint16)
    return ((wide << by | wide >> (8 - by)) & 0xFF).astype(np.uint8)


def inverse(table: bytes) -> bytes:
    out = bytearray(256)
    for i, b in enumerate(table):
        out[b] = i
    return bytes(out)


SPIN = rotate_left(BYTES, np.bitwise_count(BYTES).astype(np.uint16)).tobytes()  # by the byte's own bit count
UNSPIN = inverse(SPIN)
LEFT2 = rotate_left(BYTES, 2).tobytes()
RIGHT2 = inverse(LEFT2)
PAIRS = ((BYTES & 0xAA) >> 1 | (BYTES & 0x55) << 1).astype(np.uint8).tobytes()  # neighbouring bits swapped


def xor_byte(data: bytes, key: int) -> bytes:
    return (np.frombuffer(data, np.uint8) ^ np.uint8(key)).tobytes() if key else data


def hash_xor(data: bytes, key: int, shift: int = 0) -> bytes:
    return xor_byte(data, key >> shift & 0xFF)


def successor_xor(data: bytes, key: int) -> bytes:
    return xor_byte(data, ~(key + 1) & 0xFF)


def fixed_xor(data: bytes, key: bytes | str) -> bytes:
    """The key, bytes or hex digits, over and over."""
    if isinstance(key, str):
        try:
            key = bytes.fromhex(key)
        except ValueError:
            raise MalformedError(f"key {key!r} isn't hex") from None
    if not key:
        raise MalformedError("empty key")
    return (np.frombuffer(data, np.uint8) ^ np.resize(np.frombuffer(key, np.uint8), len(data))).tobytes()


def spin_decrypt(data: bytes) -> bytes:
    return data.translate(SPIN)


def spin_encrypt(data: bytes) -> bytes:
    return data.translate(UNSPIN)


def script_decrypt(data: bytes) -> bytes:
    return data.translate(RIGHT2)


def script_encrypt(data: bytes) -> bytes:
    return data.translate(LEFT2)


# --- scripts with a keyed header ---------------------------------------------

#: For each key, the bit to which bits 0 to 7 go when decrypting.
BIT_PLACES = (
    (2, 7, 1, 3, 5, 0, 4, 6),
    (3, 5, 2, 6, 1, 7, 0, 4),
    (7, 6, 5, 4, 3, 2, 1, 0),
    (3, 2, 1, 0, 7, 6, 5, 4),
    (6, 4, 0, 7, 1, 3, 5, 2),
    (5, 7, 6, 2, 0, 1, 4, 3),
    (7, 0, 6, 1, 2, 4, 3, 5),
    (1, 6, 0, 2, 5, 7, 4, 3),
)
#: For each shuffle, the byte that comes to each place of a group; each is its own inverse.
BYTE_PLACES = ((1, 0), (2, 3, 0, 1), (6, 4, 5, 7, 1, 2, 0, 3))


@lru_cache(maxsize=None)
def _bit_tables(key: int) -> tuple[bytes, bytes]:
    moved = sum(((BYTES >> bit & 1) << place for bit, place in enumerate(BIT_PLACES[key])), np.zeros(256, np.uint8))
    table = (~moved).astype(np.uint8).tobytes()
    return table, inverse(table)


def _shuffle(body: bytes, key: int) -> bytes:
    if key >= len(BYTE_PLACES):
        return body
    places = BYTE_PLACES[key]
    whole = len(body) // len(places) * len(places)
    groups = np.frombuffer(body[:whole], np.uint8).reshape(-1, len(places))
    return groups[:, places].tobytes() + body[whole:]


def keyed_script(data: bytes, encrypt: bool = False) -> bytes:
    """The first four bytes stay; the first two, less 0xF0, choose the bit and byte places."""
    if len(data) < 4 or (bits := data[0] ^ 0xF0) >= len(BIT_PLACES):
        return data
    body, tables = data[4:], _bit_tables(bits)
    if encrypt:
        return data[:4] + _shuffle(body.translate(tables[1]), data[1] ^ 0xF0)
    return data[:4] + _shuffle(body, data[1] ^ 0xF0).translate(tables[0])


# --- framed UTF-16 text --------------------------------------------------------

FRAME, BOM = b"\xfe\xfe", b"\xff\xfe"
XOR_MODE, PAIRS_MODE, ZLIB_MODE = 0, 1, 2


def text_mode(data: bytes) -> int | None:
    """The frame's mode; None without a frame."""
    if data[:2] != FRAME:
        return None
    if len(data) < 3:
        raise MalformedError("the frame ends before its mode")
    return data[2]


def _units(body: bytes) -> np.ndarray:
    if len(body) % 2:
        raise MalformedError("an odd number of bytes of UTF-16")
    return np.frombuffer(body, "<u2")


def unit_xor(body: bytes) -> bytes:
    """Code units from 0x20 on, XORed with their low byte's upper bits in the high byte and with 1."""
    units = _units(body)
    return np.where(units >= 0x20, units ^ ((units & 0xFE) << 8 ^ 1), units).astype("<u2").tobytes()


def swap_pairs(body: bytes) -> bytes:
    _units(body)
    return body.translate(PAIRS)


def _inflate_sized(body: bytes) -> bytes:
    if len(body) < 16:
        raise MalformedError("the frame ends before its sizes")
    packed, size = struct.unpack("<QQ", body[:16])
    stream = body[16:]
    if len(stream) < packed:
        raise MalformedError(f"{len(stream)} of {packed} packed bytes")
    try:
        out = zlib.decompress(stream[:packed] if packed else stream)
    except zlib.error as e:
        raise MalformedError(str(e)) from None
    if size and len(out) != size:
        raise MalformedError(f"{len(out)} bytes instead of {size}")
    return out


def text_decode(data: bytes) -> bytes:
    """UTF-16 with its mark out of a frame; bytes without a frame as they are."""
    mode = text_mode(data)
    if mode is None:
        return data
    if mode not in (XOR_MODE, PAIRS_MODE, ZLIB_MODE):
        raise MalformedError(f"mode {mode}")
    if data[3:5] != BOM:
        raise MalformedError("no byte order mark in the frame")
    return BOM + (unit_xor, swap_pairs, _inflate_sized)[mode](data[5:])


def text_encode(data: bytes, mode: int = PAIRS_MODE) -> bytes:
    if mode not in (PAIRS_MODE, ZLIB_MODE):
        raise MalformedError(f"mode {mode} isn't written")
    if data[:2] != BOM:
        raise MalformedError("no byte order mark")
    body = data[2:]
    if mode == PAIRS_MODE:
        body = swap_pairs(body)
    else:
        packed = zlib.compress(body)
        body = struct.pack("<QQ", len(packed), len(body)) + packed
    return FRAME + bytes([mode]) + BOM + body


# --- registry ------------------------------------------------------------------


@dataclass(frozen=True)
class Cipher:
    """decrypt and encrypt take (data, key, **parameters)."""

    decrypt: Callable[..., bytes]
    encrypt: Callable[..., bytes]
    needs: tuple[str, ...] = ()


def _both(function: Callable[..., bytes], *needs: str) -> Cipher:
    return Cipher(function, function, needs)


def _program(data: bytes, key: int, **parameters) -> bytes:
    from vaultlens.codecs.program import program_xor

    return program_xor(data, key, **parameters)


#: In the order in which schemes without parameters are probed.
CIPHERS: dict[str, Cipher] = {
    "fixed-xor": Cipher(lambda d, k, **p: fixed_xor(d, p["key"]), lambda d, k, **p: fixed_xor(d, p["key"]), ("key",)),
    "hash-xor": _both(lambda d, k, **p: hash_xor(d, k, int(p["shift"])), "shift"),
    "null": _both(lambda d, k, **p: d),
    "poringsoft": _both(lambda d, k, **p: successor_xor(d, k)),
    "cxcrypt": _both(_program, "control_block"),
    "pinpoint": Cipher(lambda d, k, **p: spin_decrypt(d), lambda d, k, **p: spin_encrypt(d)),
}


def register_cipher(name: str, decrypt: Callable[..., bytes], encrypt: Callable[..., bytes], needs: tuple[str, ...] = ()) -> None:
    """Add a cipher of one's own; it is probed last."""
    CIPHERS[name] = Cipher(decrypt, encrypt, needs)


def apply_cipher(data: bytes, key: int, name: str | None, parameters: dict | None = None, encrypt: bool = False) -> bytes:
    if not name:
        return data
    if name not in CIPHERS:
        raise MalformedError(f"unknown scheme {name!r}")
    cipher, parameters = CIPHERS[name], parameters or {}
    if missing := [n for n in cipher.needs if n not in parameters]:
        raise MalformedError(f"{name} needs {', '.join(missing)}")
    return (cipher.encrypt if encrypt else cipher.decrypt)(data, key & 0xFFFFFFFF, **parameters)
