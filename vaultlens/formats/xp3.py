"""Archives with a tagged file table: sections hold chunks, entries hold segments, aliases point at checksums."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence

from vaultlens.codecs.ciphers import apply_cipher
from vaultlens.codecs.errors import MalformedError
from vaultlens.formats.model import Entry, Member, Segment

MAGIC = b"XP3\r\n \n\x1a\x8b\x67\x01"
CONTINUED = 0x80
ENCRYPTED, PACKED = 1 << 31, 1
TABLE_AT = 0x20  # of the writer's table offset
MOST = (1 << 63) - 1


def table_place(data: bytes) -> int:
    """Where the file table's flag byte is."""
    if data[: len(MAGIC)] != MAGIC:
        raise MalformedError("no archive magic")
    try:
        at = struct.unpack_from("<Q", data, len(MAGIC))[0]
        if data[at] == CONTINUED:
            at = struct.unpack_from("<Q", data, at + 9)[0]
        data[at]
        return at
    except (struct.error, IndexError, OverflowError):
        raise MalformedError("the file table is past the end") from None


def file_table(data: bytes) -> bytes:
    at = table_place(data)
    try:
        if data[at]:
            return zlib.decompress(data[at + 17 : at + 17 + struct.unpack_from("<Q", data, at + 1)[0]])
        return data[at + 9 : at + 9 + struct.unpack_from("<Q", data, at + 1)[0]]
    except (struct.error, zlib.error) as e:
        raise MalformedError(f"file table: {e}") from None


def structure_digest(data: bytes) -> str:
    """SHA-256 of header, flag byte, 16 bytes of sizes and the table by the first size.

    A plain table has one size only; its first 8 bytes are then taken for the
    second, and the table from there, so that digests agree with known ones.
    """
    at = table_place(data)
    sizes = data[at + 1 : at + 17]
    n = int.from_bytes(sizes[:8], "little")
    return hashlib.sha256(data[:19] + data[at : at + 1] + sizes + data[at + 17 : at + 17 + n]).hexdigest()


def tagged(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(tag, content), up to the first item that doesn't fit."""
    pos = 0
    while pos + 12 <= len(raw):
        tag, size = struct.unpack_from("<4sQ", raw, pos)
        if pos + 12 + size > len(raw):
            return
        yield tag, raw[pos + 12 : pos + 12 + size]
        pos += 12 + size


def _name(raw: bytes, at: int) -> str:
    n = struct.unpack_from("<H", raw, at)[0]
    if at + 2 + 2 * n > len(raw):
        raise MalformedError("a name ends early")
    return raw[at + 2 : at + 2 + 2 * n].decode("utf-16-le")


def _small(*values: int) -> tuple[int, ...]:
    if any(v > MOST for v in values):
        raise MalformedError("a size of 64 bits")
    return values


def _entry(section: bytes) -> Entry:
    entry = Entry("")
    for tag, body in tagged(section):
        if tag == b"info":
            entry.flags, original, stored = struct.unpack_from("<IQQ", body)
            entry.original_size, entry.stored_size = _small(original, stored)
            entry.encrypted, entry.file_name = bool(entry.flags & ENCRYPTED), _name(body, 20)
        elif tag == b"adlr":
            entry.key = struct.unpack_from("<I", body)[0]
        elif tag == b"time":
            entry.filetime = _small(struct.unpack_from("<Q", body)[0])[0]
        elif tag == b"segm":
            for k, (flags, *sizes) in enumerate(struct.iter_unpack("<IQQQ", body[: len(body) // 28 * 28])):
                entry.segments.append(Segment(k, flags, bool(flags & PACKED), *_small(*sizes)))
    if entry.segments:
        entry.offset, entry.compressed = entry.segments[0].offset, entry.segments[0].compressed
    return entry


def parse(data: bytes, one_per_key: bool = False) -> list[Entry]:
    """Entries in order, then aliases.

    one_per_key: of entries with one checksum the last counts, at the first's place.
    """
    entries: list[Entry] = []
    aliases: dict[int, str] = {}
    try:
        for tag, body in tagged(file_table(data)):
            if tag == b"File":
                entries.append(_entry(body))
            elif tag == b"eliF":
                aliases[struct.unpack_from("<I", body)[0]] = _name(body, 4)
    except (struct.error, UnicodeDecodeError) as e:
        raise MalformedError(f"file table: {e}") from None
    by_key = {e.key: e for e in entries}
    if one_per_key:
        entries = list(by_key.values())
    for key, name in aliases.items():
        if key not in by_key:
            raise MalformedError(f"alias {name!r} of unknown checksum {key:#x}")
        fields = vars(by_key[key]) | {"file_name": name, "filetime": None, "is_alias": True}
        entries.append(Entry(**fields))
    return entries


def read_segment(raw: bytes, segment: Segment, entry: Entry, scheme: str | None = None, parameters: dict | None = None, force: bool = False) -> bytes:
    """A flag that wrongly says encrypted is seen by packed data that only inflates as it is."""
    try:
        if not scheme or not (entry.encrypted or force):
            return zlib.decompress(raw) if segment.compressed else raw
        plain = apply_cipher(raw, entry.key or 0, scheme, parameters)
        if not segment.compressed:
            return plain
        try:
            return zlib.decompress(plain)
        except zlib.error:
            return zlib.decompress(raw)
    except zlib.error as e:
        raise MalformedError(f"segment {segment.ordinal}: {e}") from None


def read(data: bytes, entry: Entry, scheme: str | None = None, parameters: dict | None = None, force: bool = False) -> bytes:
    return b"".join(read_segment(data[s.offset : s.offset + s.compressed_size], s, entry, scheme, parameters, force) for s in entry.segments)


def try_decrypt(raw: bytes, segment: Segment, key: int, scheme: str, parameters: dict | None = None) -> bytes | None:
    """Decrypted and inflated, None if that fails."""
    try:
        plain = apply_cipher(raw, key, scheme, parameters)
        return zlib.decompress(plain) if segment.compressed else plain
    except (MalformedError, zlib.error, TypeError):
        return None


def _chunk(tag: bytes, body: bytes) -> bytes:
    return struct.pack("<4sQ", tag, len(body)) + body


def _utf16(name: str) -> bytes:
    raw = name.encode("utf-16-le")
    return struct.pack("<H", len(raw) // 2) + raw


def build(
    members: Sequence[Member], compress: bool = True, scheme: str | None = None, parameters: dict | None = None, table_packed: bool = True, level: int = -1,
    aliases: Sequence[tuple[str, str]] = (),
) -> bytes:
    """One segment a member, packed and then encrypted; aliases are (name, name of the member)."""
    out = bytearray(MAGIC + struct.pack("<QIBQQ", 0x17, 1, CONTINUED, 0, 0))
    table, keys = [], {}
    for m in members:
        key = zlib.adler32(m.data)
        part = apply_cipher(zlib.compress(m.data, level) if compress else m.data, key, scheme, parameters, encrypt=True)
        info = struct.pack("<IQQ", ENCRYPTED if scheme else 0, len(m.data), len(part)) + _utf16(m.file_name)
        segment = struct.pack("<IQQQ", int(compress), len(out), len(m.data), len(part))
        table.append(_chunk(b"File", _chunk(b"info", info) + _chunk(b"segm", segment) + _chunk(b"adlr", struct.pack("<I", key))))
        keys[m.file_name] = key
        out += part
    table += [_chunk(b"eliF", struct.pack("<I", keys[of]) + _utf16(name)) for name, of in aliases]
    raw = b"".join(table)
    struct.pack_into("<Q", out, TABLE_AT, len(out))
    packed = zlib.compress(raw)
    out += struct.pack("<BQQ", 1, len(packed), len(raw)) + packed if table_packed else struct.pack("<BQ", 0, len(raw)) + raw
    return bytes(out)
