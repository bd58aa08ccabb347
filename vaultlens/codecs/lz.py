"""Three small LZ codecs: marker LZ77, flag-bit LZSS with a 4 KiB ring, and its image variant."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from vaultlens.codecs.errors import MalformedError

# --- marker LZ77: 0xFF starts a reference, FF FF is a literal FF -------------

MARK = 0xFF
FARTHEST = 64
SHORTEST, LONGEST = 3, 6


def marker_decode(data: bytes) -> bytes:
    """References are (distance - 1) << 2 | (length - 3); a lone mark at the end is dropped."""
    out = bytearray()
    pos, end = 0, len(data)
    while pos < end:
        mark = data.find(MARK, pos)
        if mark < 0:
            out += data[pos:]
            break
        out += data[pos:mark]
        if mark + 1 >= end:
            break
        code = data[mark + 1]
        pos = mark + 2
        if code == MARK:
            out.append(MARK)
            continue
        distance, length = (code >> 2) + 1, (code & 3) + SHORTEST
        start = len(out) - distance
        if start < 0:
            raise MalformedError(f"reference {distance} back from position {len(out)}")
        seen = bytes(out[start : start + length])
        out += (seen * (length // len(seen) + 1))[:length]
    return bytes(out)


def marker_store(data: bytes) -> bytes:
    """Literals only."""
    return data.replace(b"\xff", b"\xff\xff")


#: Places whose matches are looked for at once.
SEARCHED = 8192


def longest_matches(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(length, distance) of the longest match of 3 to 6 bytes at each place, the nearest of those; length 0 without one."""
    n, edge = len(data), np.full(max(FARTHEST, LONGEST), -1, np.int16)
    raw = np.concatenate([edge, np.frombuffer(data, np.uint8).astype(np.int16), edge])
    best = np.zeros(n, np.int64)
    for start in range(0, n, SEARCHED):
        count = min(SEARCHED, n - start)
        wide = count + LONGEST - 1
        rows = sliding_window_view(raw[start + len(edge) - FARTHEST : start + len(edge) + wide], wide)
        same = rows[:FARTHEST] == rows[FARTHEST]  # row r is what lies FARTHEST - r places back
        same[:, max(0, n - start) :] = False
        row, at = np.nonzero(same[:, :count] & same[:, 1 : count + 1] & same[:, 2 : count + 2])
        size, on = np.full(len(at), SHORTEST), np.ones(len(at), bool)
        for k in range(SHORTEST, LONGEST):
            on &= same[row, at + k]
            size += on
        np.maximum.at(best, at + start, size * FARTHEST + row)
    return best // FARTHEST, FARTHEST - best % FARTHEST


def marker_encode(data: bytes) -> bytes:
    """Greedy: the longest match, the nearest of those; the code that would be the mark gives up one byte."""
    length, distance = longest_matches(data)
    places = np.flatnonzero(length)
    out, done = bytearray(), 0
    for at, size, d in zip(places.tolist(), length[places].tolist(), distance[places].tolist(), strict=True):
        if at < done:
            continue
        out += marker_store(data[done:at])
        code = (d - 1) << 2 | (size - SHORTEST)
        if code == MARK:
            code, size = code - 1, size - 1
        out.append(MARK)
        out.append(code)
        done = at + size
    return bytes(out + marker_store(data[done:]))


# --- LZSS with a 4 KiB ring, a set flag bit is a literal ---------------------

RING = 4096


def sized_lzss_decode(data: bytes) -> bytes:
    """A 32-bit size, then flags and items; the ring is zero and first written at 1."""
    if len(data) < 4:
        raise MalformedError("no size")
    size = int.from_bytes(data[:4], "little")
    ring, at = bytearray(RING), 1
    out = bytearray()
    pos = 4
    try:
        while len(out) < size:
            flags = data[pos]
            pos += 1
            for bit in range(8):
                if len(out) >= size:
                    break
                if flags >> bit & 1:
                    run = data[pos : pos + 1]
                    if not run:
                        raise IndexError
                    pos += 1
                    ring[at % RING] = run[0]
                    at += 1
                    out += run
                    continue
                word = data[pos] << 8 | data[pos + 1]
                pos += 2
                for k in range(min((word & 15) + 2, size - len(out))):
                    byte = ring[((word >> 4) + k) % RING]
                    ring[at % RING] = byte
                    at += 1
                    out.append(byte)
    except IndexError:
        raise MalformedError(f"input ends after {len(out)} of {size} bytes") from None
    return bytes(out)


def sized_lzss_encode(data: bytes) -> bytes:
    """Literals only, for round trips."""
    out = bytearray(len(data).to_bytes(4, "little"))
    for i in range(0, len(data), 8):
        part = data[i : i + 8]
        out.append((1 << len(part)) - 1)
        out += part
    return bytes(out)


# --- the image variant: a set flag bit is a reference ------------------------


class ImageRing:
    """The ring of the image LZSS; its content and place carry over from call to call."""

    LONG = 18

    def __init__(self, initial: bytes | None = None):
        self.ring = bytearray(initial) if initial is not None else bytearray(RING)
        self.at = 0

    def decode(self, data: bytes, size: int) -> bytes:
        """At most size bytes; input that ends early gives fewer, padded with zeros."""
        ring, at, out = self.ring, self.at, bytearray()
        pos, end = 0, len(data)
        while pos < end and len(out) < size:
            flags = data[pos] | 0x100
            pos += 1
            while flags > 1 and len(out) < size and pos < end:
                reference, flags = flags & 1, flags >> 1
                if not reference:
                    ring[at] = data[pos]
                    out.append(data[pos])
                    at = (at + 1) % RING
                    pos += 1
                    continue
                if pos + 1 >= end:
                    pos = end
                    break
                source, length = data[pos] | (data[pos + 1] & 15) << 8, (data[pos + 1] >> 4) + 3
                pos += 2
                if length == self.LONG:
                    if pos >= end:
                        break
                    length += data[pos]
                    pos += 1
                for k in range(min(length, size - len(out))):
                    byte = ring[(source + k) % RING]
                    ring[at] = byte
                    out.append(byte)
                    at = (at + 1) % RING
        self.at = at
        return bytes(out.ljust(size, b"\0"))


def image_encode(data: bytes) -> bytes:
    """Literals only, for round trips."""
    return b"".join(b"\0" + data[i : i + 8] for i in range(0, len(data), 8))
