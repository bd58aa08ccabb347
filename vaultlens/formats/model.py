"""What parsers give: entries with their segments, alike for every format."""

from __future__ import annotations

from dataclasses import dataclass, field

ENTRY_SCHEMA = (
    "archive string, ordinal int, file_name string, offset long, stored_size long, original_size long, flags long, encrypted boolean, compressed boolean,"
    " scrambled boolean, key long, crc32 long, ts timestamp_ntz, filetime long, is_alias boolean,"
    " segments array<struct<ordinal:int,flags:bigint,compressed:boolean,offset:bigint,original_size:bigint,compressed_size:bigint>>"
)


@dataclass
class Segment:
    ordinal: int
    flags: int
    compressed: bool
    offset: int
    original_size: int
    compressed_size: int


@dataclass
class Entry:
    file_name: str
    offset: int = 0
    stored_size: int = 0
    original_size: int | None = None
    flags: int = 0
    encrypted: bool = False
    compressed: bool = False
    scrambled: bool = False
    key: int | None = None
    crc32: int | None = None
    ts: object = None
    filetime: int | None = None
    is_alias: bool = False
    segments: list[Segment] = field(default_factory=list)

    def row(self, archive: str, ordinal: int) -> tuple:
        head = (archive, ordinal, self.file_name, self.offset, self.stored_size, self.original_size, self.flags, self.encrypted, self.compressed)
        tail = (self.scrambled, self.key, self.crc32, self.ts, self.filetime, self.is_alias)
        return (*head, *tail, [tuple(vars(s).values()) for s in self.segments])


@dataclass
class Member:
    """What builders are given."""

    file_name: str
    data: bytes
    ts: object = None
