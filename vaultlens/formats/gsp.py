"""Fixed-record archives: a count, 64-byte records (offset, size, 56-byte ASCII name), data."""

from __future__ import annotations

import struct
from collections.abc import Sequence

from vaultlens.codecs.ciphers import keyed_script
from vaultlens.codecs.errors import MalformedError
from vaultlens.formats.model import Entry, Member

RECORD, NAME = 64, 56


def is_keyed(name: str) -> bool:
    return "." in name and name.rpartition(".")[2].lower() in ("spt", "dat")


def parse(data: bytes) -> list[Entry]:
    if len(data) < 4:
        raise MalformedError("no count")
    count = struct.unpack_from("<I", data)[0]
    if 4 + count * RECORD > len(data):
        raise MalformedError(f"{count} records in {len(data)} bytes")
    out = []
    for offset, size, name in struct.iter_unpack(f"<II{NAME}s", data[4 : 4 + count * RECORD]):
        try:
            out.append(Entry(name.split(b"\0", 1)[0].decode("ascii"), offset, size))
        except UnicodeDecodeError as e:
            raise MalformedError(f"name {name!r}: {e.reason}") from None
    return out


def read(data: bytes, entry: Entry, decrypt: bool = True) -> bytes:
    part = data[entry.offset : entry.offset + entry.stored_size]
    if len(part) < entry.stored_size:
        raise MalformedError("member ends early")
    return keyed_script(part) if decrypt and is_keyed(entry.file_name) else part


def build(members: Sequence[Member], encrypt: bool = True) -> bytes:
    """Scripts must begin with their key bytes, as in plain files of the format."""
    names, parts = [m.file_name.encode("ascii") for m in members], []
    for m, name in zip(members, names, strict=True):
        if len(name) > NAME:
            raise MalformedError(f"name of {len(name)} bytes")
        parts.append(keyed_script(m.data, True) if encrypt and is_keyed(m.file_name) else m.data)
    out, at = [struct.pack("<I", len(members))], 4 + RECORD * len(members)
    for name, part in zip(names, parts, strict=True):
        out.append(struct.pack(f"<II{NAME}s", at, len(part), name))
        at += len(part)
    return b"".join(out + parts)
