"""Archives with a masked, column-wise index, alone, in an executable, or beside numbered parts."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

from vaultlens.codecs.errors import MalformedError
from vaultlens.codecs.prng import mask_bytes, mask_states, scramble, unscramble
from vaultlens.formats.model import Entry, Member
from vaultlens.functions.dos_time import dos_decode, dos_encode

MAGIC, VERSION, HEADER = b"vf", 102, 10
TRAILER_TAG = b"lv"
CHUNK = 0x1000
#: Extensions whose members are packed unless told otherwise.
PACKED = (".lsb", ".lpb", ".lpm", ".txt")
#: flag -> (compressed, scrambled); others are stored
FLAGS = {0: (True, False), 1: (False, False), 2: (False, True), 3: (True, True)}


def base_offset(data: bytes) -> int:
    """Where an archive begins in an executable; 0 if there is no trailer that leads to one."""
    if len(data) < 6 or data[-2:] != TRAILER_TAG:
        return 0
    base = struct.unpack("<I", data[-6:-2])[0]
    return base if base < len(data) and data[base : base + 2] == MAGIC else 0


def _masked_offsets(raw: np.ndarray) -> np.ndarray:
    return raw ^ mask_states(1, len(raw)).astype(np.uint32).view(np.int32).astype(np.int64)


def parse(data: bytes) -> list[Entry]:
    """data: the index, at its first byte; offsets count from the first byte of the whole stream."""
    if data[:2] != MAGIC or len(data) < HEADER:
        raise MalformedError("no index magic")
    version, n = struct.unpack_from("<II", data, 2)
    if version != VERSION:
        raise MalformedError(f"version {version}")
    pos, seen, names = HEADER, 0, []
    for _ in range(n):
        size = int.from_bytes(data[pos : pos + 4], "little")
        raw = data[pos + 4 : pos + 4 + size]
        if not 0 < size <= 0x1000 or len(raw) < size:
            raise MalformedError(f"name of {size} bytes")
        try:
            names.append(mask_bytes(raw, 1 + seen).decode("cp932"))
        except UnicodeDecodeError as e:
            raise MalformedError(f"name: {e.reason}") from None
        pos, seen = pos + 4 + size, seen + size
    if pos + 8 * (n + 1) + 10 * n > len(data):
        raise MalformedError("index ends early")
    offsets = _masked_offsets(np.frombuffer(data, "<i8", n + 1, pos))
    pos += 8 * (n + 1)
    flags = data[pos : pos + n]
    times, sums = np.frombuffer(data, "<u4", n, pos + n), np.frombuffer(data, "<u4", n, pos + 5 * n)
    out = []
    for i, name in enumerate(names):
        packed, mixed = FLAGS.get(flags[i], (False, False))
        size = int(offsets[i + 1] - offsets[i])
        out.append(Entry(name, int(offsets[i]), size, flags=flags[i], compressed=packed, scrambled=mixed, crc32=int(sums[i]), ts=dos_decode(int(times[i]))))
    return out


def slice_parts(parts: Sequence[tuple[int, int]], offset: int, size: int) -> list[tuple[int, int, int]]:
    """(part, from, to) that make up [offset, offset + size) of parts (start, end) in order."""
    out, at = [], offset
    for k, (start, end) in enumerate(parts):
        if size > 0 and start <= at < end:
            stop = min(end, offset + size)
            out.append((k, at - start, stop - start))
            at = stop
    if at < offset + max(size, 0):
        raise MalformedError(f"bytes from {at} are in no part")
    return out


def read(stream: bytes, entry: Entry, check: bool = False) -> bytes:
    """stream: the whole logical stream; for an executable, from its archive's first byte."""
    part = stream[entry.offset : entry.offset + max(0, entry.stored_size)]
    if len(part) < entry.stored_size:
        raise MalformedError("member ends early")
    if check and zlib.crc32(part) != entry.crc32:
        raise MalformedError("checksum differs")
    if entry.scrambled:
        part = unscramble(part)
    if entry.compressed:
        try:
            part = zlib.decompress(part)
        except zlib.error as e:
            raise MalformedError(str(e)) from None
    return part


def build(members: Sequence[Member], compress: bool | None = None, mix: bool = False, executable: bytes | None = None) -> bytes:
    """compress None: by extension."""
    names = [m.file_name.replace("/", "\\").encode("cp932") for m in members]
    parts, flags = [], []
    for m in members:
        packed = m.file_name.lower().endswith(PACKED) if compress is None else compress
        part = zlib.compress(m.data) if packed else m.data
        parts.append(scramble(part, CHUNK) if mix else part)
        flags.append(next(f for f, kind in FLAGS.items() if kind == (packed, mix)))
    n, seen, index = len(members), 0, [MAGIC + struct.pack("<II", VERSION, len(members))]
    for name in names:
        index.append(struct.pack("<I", len(name)) + mask_bytes(name, 1 + seen))
        seen += len(name)
    at = sum(map(len, index)) + 8 * (n + 1) + 10 * n
    offsets = np.cumsum([at, *map(len, parts)]).astype("<i8")
    index += [_masked_offsets(offsets).astype("<i8").tobytes(), bytes(flags)]
    index.append(np.array([dos_encode(m.ts) if m.ts else 0x00210000 for m in members], "<u4").tobytes())
    index += [np.array([zlib.crc32(p) for p in parts], "<u4").tobytes(), bytes(n)]
    out = b"".join(index + parts)
    return out if executable is None else executable + out + struct.pack("<I", len(executable)) + TRAILER_TAG
