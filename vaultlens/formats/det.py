"""Archives of three files: packed data, NUL-ended Shift-JIS names, and an index of 16 or 20-byte records."""

from __future__ import annotations

import struct
from collections.abc import Sequence

from vaultlens.codecs.errors import MalformedError
from vaultlens.codecs.lz import marker_decode, marker_encode, marker_store
from vaultlens.formats.model import Entry, Member

TRAILER = bytes(4)
#: Index kind -> record; the last field is the unpacked size.
RECORDS = {"at2": struct.Struct("<iII4xI"), "atm": struct.Struct("<iII4x")}
#: (file, kind to read it as), in the order in which they are tried.
ATTEMPTS = (("at2", "at2"), ("atm", "atm"), ("atm", "at2"))


def parse_as(kind: str, index: bytes, names: bytes, data_size: int) -> list[Entry]:
    record = RECORDS[kind]
    body = index[: len(index) - len(TRAILER)]
    if len(index) < len(TRAILER) or len(body) % record.size:
        raise MalformedError(f"index of {len(index)} bytes")
    if not body:
        raise MalformedError("index without entries")
    out = []
    for at, offset, size, *unpacked in record.iter_unpack(body):
        if not 0 <= at < len(names):
            raise MalformedError(f"name at {at} of {len(names)}")
        if offset + size > data_size:
            raise MalformedError(f"data to {offset + size} of {data_size}")
        out.append((at, offset, size, unpacked[0] if unpacked else None))
    entries = []
    for at, offset, size, unpacked in out:
        end = names.find(b"\0", at)
        if end < 0:
            raise MalformedError("a name doesn't end")
        try:
            entries.append(Entry(names[at:end].decode("shift_jis"), offset, size, unpacked, compressed=True))
        except UnicodeDecodeError as e:
            raise MalformedError(f"name: {e.reason}") from None
    return entries


def parse(files: dict[str, bytes], kind: str | None = None) -> list[Entry]:
    """files: det, nme, and at2 or atm; the first attempt that parses and is valid counts."""
    if "nme" not in files:
        raise MalformedError("no names file")
    why: list[str] = []
    for file, read_as in ATTEMPTS:
        if file in files and kind in (None, read_as):
            try:
                return parse_as(read_as, files[file], files["nme"], len(files["det"]))
            except MalformedError as e:
                why.append(f"{file} as {read_as}: {e}")
    raise MalformedError("; ".join(why) or "no index file")


def read(data: bytes, entry: Entry, check: bool = False) -> bytes:
    out = marker_decode(data[entry.offset : entry.offset + entry.stored_size])
    if check and entry.original_size is not None and len(out) != entry.original_size:
        raise MalformedError(f"{len(out)} bytes instead of {entry.original_size}")
    return out


def build(members: Sequence[Member], kind: str = "at2", compress: bool = False) -> dict[str, bytes]:
    """The three files; an archive without members has all three as well, which can't be read back."""
    data, names, index = bytearray(), bytearray(), bytearray()
    for m in members:
        packed = marker_encode(m.data) if compress else marker_store(m.data)
        fields = (len(names), len(data), len(packed))
        index += RECORDS[kind].pack(*fields, len(m.data)) if kind == "at2" else RECORDS[kind].pack(*fields)
        names += m.file_name.replace("/", "\\").encode("shift_jis") + b"\0"
        data += packed
    return {"det": bytes(data) + TRAILER, "nme": bytes(names) + TRAILER, kind: bytes(index) + TRAILER}
