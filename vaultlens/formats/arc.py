"""Archives with variable records: count, index size, then size, relative offset and a NUL-ended UTF-16 name."""

from __future__ import annotations

import os
import struct
from collections.abc import Sequence

from vaultlens.codecs.ciphers import script_decrypt, script_encrypt
from vaultlens.codecs.errors import MalformedError
from vaultlens.formats.model import Entry, Member

SCRIPTS = (".ws2", ".json")


def is_script(name: str) -> bool:
    return os.path.splitext(name)[1].lower() in SCRIPTS


def parse(data: bytes) -> list[Entry]:
    if len(data) < 8:
        raise MalformedError("no header")
    count, size = struct.unpack_from("<II", data)
    base, pos, out = 8 + size, 8, []
    for _ in range(count):
        if pos + 8 > len(data):
            raise MalformedError("index ends early")
        length, offset = struct.unpack_from("<II", data, pos)
        pos += 8
        end = pos
        while (unit := data[end : end + 2]) != b"\0\0":
            if len(unit) < 2:
                raise MalformedError("index ends early")
            end += 2
        try:
            out.append(Entry(data[pos:end].decode("utf-16-le"), base + offset, length))
        except UnicodeDecodeError as e:
            raise MalformedError(f"name: {e.reason}") from None
        pos = end + 2
    if pos != base:
        raise MalformedError(f"index of {pos - 8} bytes, {size} in the header")
    return out


def read(data: bytes, entry: Entry, archive: str = "", decrypt: bool = True) -> bytes:
    """Scripts of archives with ``Model`` in their name are plain."""
    part = data[entry.offset : entry.offset + entry.stored_size]
    if len(part) < entry.stored_size:
        raise MalformedError("member ends early")
    plain = not decrypt or "Model" in os.path.basename(archive) or not is_script(entry.file_name)
    return part if plain else script_decrypt(part)


def build(members: Sequence[Member], encrypt: bool = True) -> bytes:
    parts = [script_encrypt(m.data) if encrypt and is_script(m.file_name) else m.data for m in members]
    index, at = [], 0
    for m, part in zip(members, parts, strict=True):
        index.append(struct.pack("<II", len(part), at) + m.file_name.encode("utf-16-le") + b"\0\0")
        at += len(part)
    raw = b"".join(index)
    return struct.pack("<II", len(members), len(raw)) + raw + b"".join(parts)
