"""A PNG writer and the reader that tests need: 8 bits a channel, RGB or RGBA."""

from __future__ import annotations

import struct
import zlib

MAGIC = b"\x89PNG\r\n\x1a\n"


def encode(width: int, height: int, mode: str, pixels: bytes) -> bytes:
    channels = {"RGB": 3, "RGBA": 4}[mode]
    stride = width * channels
    rows = b"".join(b"\0" + pixels[y * stride : (y + 1) * stride] for y in range(height))

    def chunk(tag: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 6, 0, 0, 0)
    return MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def decode(data: bytes) -> tuple[int, int, str, bytes]:
    """What encode() was given."""
    pos, body, head = len(MAGIC), b"", b""
    while pos < len(data):
        size, tag = struct.unpack_from(">I4s", data, pos)
        part = data[pos + 8 : pos + 8 + size]
        head, body = (part, body) if tag == b"IHDR" else (head, body + part if tag == b"IDAT" else body)
        pos += 12 + size
    width, height, _, kind = struct.unpack_from(">IIBB", head)
    stride = width * (3 if kind == 2 else 4) + 1
    rows = zlib.decompress(body)
    return width, height, "RGB" if kind == 2 else "RGBA", b"".join(rows[y * stride + 1 : (y + 1) * stride] for y in range(height))
