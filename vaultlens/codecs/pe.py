"""Version strings of Windows executables, from their version resource."""

from __future__ import annotations

import struct
from collections.abc import Iterator

ROOT = "VS_VERSION_INFO".encode("utf-16-le") + b"\0\0"


def _aligned(pos: int) -> int:
    return -(-pos // 4) * 4


def _blocks(data: bytes, start: int, end: int) -> Iterator[tuple[str, int, int, int, int]]:
    """(key, first byte of the value, units of the value, kind, end) of the blocks side by side in data."""
    while start + 6 <= end:
        size, units, kind = struct.unpack_from("<HHH", data, start)
        stop = start + size
        if size < 8 or stop > end:
            return
        at = start + 6
        while at + 2 <= stop and data[at : at + 2] != b"\0\0":
            at += 2
        key = data[start + 6 : at].decode("utf-16-le", "replace")
        yield key, _aligned(at + 2), units, kind, stop
        start = _aligned(stop)


def version_strings(data: bytes) -> dict[str, str]:
    """Name -> value of the first string table; empty without one."""
    found = data.find(ROOT)
    if data[:2] != b"MZ" or found < 6:
        return {}
    block = data[found - 6 : found - 6 + struct.unpack_from("<H", data, found - 6)[0]]
    for _, value, units, _, end in _blocks(block, 0, len(block)):
        for name, tables, _, _, stop in _blocks(block, _aligned(value + units), end):
            for _, strings, _, _, last in _blocks(block, tables, stop) if name == "StringFileInfo" else ():
                out = {}
                for key, at, n, _, close in _blocks(block, strings, last):
                    raw = block[at : min(at + 2 * n, close)]
                    out[key] = raw.decode("utf-16-le", "replace").split("\0", 1)[0]
                return out
    return {}


def version_resource(strings: dict[str, str]) -> bytes:
    """A version resource with these strings, for tests."""

    def block(key: str, value: bytes, units: int, kind: int, children: bytes = b"") -> bytes:
        head = key.encode("utf-16-le") + b"\0\0"
        body = head + bytes(-(6 + len(head)) % 4) + value
        body += bytes(-(6 + len(body)) % 4) * bool(children) + children
        return struct.pack("<HHH", 6 + len(body), units, kind) + body

    def joined(parts: list[bytes]) -> bytes:
        return b"".join(p + bytes(-len(p) % 4) for p in parts[:-1]) + (parts[-1] if parts else b"")

    rows = [block(k, v.encode("utf-16-le") + b"\0\0", len(v) + 1, 1) for k, v in strings.items()]
    table = block("StringFileInfo", b"", 0, 1, block("040904b0", b"", 0, 1, joined(rows)))
    return block("VS_VERSION_INFO", bytes(52), 52, 0, table)
