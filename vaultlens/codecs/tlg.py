"""The layered-graphics image codec: two raw variants and a container with metadata.

Decoders give (width, height, RGBA bytes); encoders exist for round trips and
fixtures.  Whole planes are handled by numpy; only the bit-serial parts loop.
"""

from __future__ import annotations

import struct

import numpy as np

from vaultlens.codecs.errors import MalformedError
from vaultlens.codecs.lz import ImageRing, image_encode

CONTAINER, STRIPS, BLOCKS = b"TLG0.0\x00sds\x1a", b"TLG5.0\x00raw\x1a", b"TLG6.0\x00raw\x1a"
MAGIC_SIZE = 11
EDGE = 8

Image = tuple[int, int, bytes]


def decode(data: bytes) -> Image:
    if len(data) < MAGIC_SIZE:
        raise MalformedError("too short for an image")
    body = data[MAGIC_SIZE:]
    try:
        match data[:MAGIC_SIZE]:
            case magic if magic == STRIPS:
                return decode_strips(body)
            case magic if magic == BLOCKS:
                return decode_blocks(body)
            case magic if magic == CONTAINER:
                return decode(inner(body))
    except (struct.error, IndexError) as e:
        raise MalformedError(f"image ends early: {e}") from None
    raise MalformedError(f"unknown image magic {data[:MAGIC_SIZE]!r}")


# --- container -------------------------------------------------------------------


def inner(body: bytes) -> bytes:
    return body[4 : 4 + struct.unpack_from("<I", body)[0]]


def metadata_chunks(body: bytes) -> list[tuple[bytes, bytes]]:
    """(name, content) of the chunks after the inner image."""
    out = []
    if len(body) < 4:
        return out
    pos = 4 + struct.unpack_from("<I", body)[0]
    while pos + 8 <= len(body):
        name, size = struct.unpack_from("<4sI", body, pos)
        out.append((name, body[pos + 8 : pos + 8 + size]))
        pos += 8 + size
    return out


def tags_by_length(text: str) -> list[tuple[str, str]]:
    """``4:LEFT=2:20,`` repeated, read by its lengths, up to the first item that doesn't fit.

    A name whose value doesn't fit is still given, with an empty value.
    """
    out, pos = [], 0

    def field(pos: int) -> tuple[str, int] | None:
        colon = text.find(":", pos)
        try:
            size = int(text[pos:colon]) if colon >= 0 else None
        except ValueError:
            size = None
        return None if size is None else (text[colon + 1 : colon + 1 + size], colon + 1 + size)

    while pos < len(text) and (name := field(pos)):
        equals = text.find("=", name[1])
        value = field(equals + 1) if equals >= 0 else None
        out.append((name[0], value[0] if value else ""))
        if not value:
            break
        pos = value[1] + (text[value[1] : value[1] + 1] == ",")
    return out


def tags_by_split(text: str) -> dict[str, str]:
    """The same, read by its commas and signs; items that lack any are left out."""
    out = {}
    for item in text.split(","):
        left, equals, right = item.strip().partition("=")
        (_, a, name), (_, b, value) = left.partition(":"), right.partition(":")
        if equals and a and b:
            out[name] = value
    return out


def wrap(image: bytes, chunks: list[tuple[bytes, bytes]] = ()) -> bytes:
    return CONTAINER + struct.pack("<I", len(image)) + image + b"".join(struct.pack("<4sI", n, len(c)) + c for n, c in chunks)


# --- strips: planes of deltas, LZSS or raw -----------------------------------------


def strips_header(body: bytes) -> tuple[int, int, int, int]:
    """(channels, width, height, rows of a strip)."""
    return struct.unpack_from("<BIII", body)


def decode_strips(body: bytes) -> Image:
    channels, width, height, rows = strips_header(body)
    if channels not in (3, 4):
        raise MalformedError(f"{channels} channels")
    if rows == 0:
        raise MalformedError("strips of no rows")
    pos = 13 + 4 * -(-height // rows)
    planes = np.zeros((4, height, width), np.uint8)  # blue, green, red, alpha
    ring = ImageRing()
    for top in range(0, height, rows):
        tall = min(rows, height - top)
        for c in range(channels):
            if pos >= len(body):
                raise MalformedError("image ends early")
            raw, size = struct.unpack_from("<BI", body, pos)
            part = body[pos + 5 : pos + 5 + size]
            pos += 5 + size
            plane = part.ljust(tall * width, b"\0")[: tall * width] if raw else ring.decode(part, tall * width)
            planes[c, top : top + tall] = np.frombuffer(plane, np.uint8).reshape(tall, width)
    return width, height, undo_deltas(planes, channels)


def undo_deltas(planes: np.ndarray, channels: int) -> bytes:
    """Blue and red are stored less green; every plane is differences along rows, then down columns."""
    planes = planes.copy()
    planes[0] += planes[1]
    planes[2] += planes[1]
    planes = np.cumsum(np.cumsum(planes, axis=2, dtype=np.uint8), axis=1, dtype=np.uint8)
    if channels == 3:
        planes[3] = 255
    return planes[[2, 1, 0, 3]].transpose(1, 2, 0).tobytes()


def encode_strips(width: int, height: int, pixels: bytes, channels: int = 4, rows: int = 4, raw: bool = False) -> bytes:
    image = np.frombuffer(pixels, np.uint8).reshape(height, width, 4)[:, :, [2, 1, 0, 3]].transpose(2, 0, 1).copy()
    if channels == 3:
        image[3] = 0
    down = np.diff(image, axis=1, prepend=np.zeros((4, 1, width), np.uint8))
    delta = np.diff(down, axis=2, prepend=np.zeros((4, height, 1), np.uint8))
    delta[0] -= delta[1]
    delta[2] -= delta[1]
    out, sizes = [], []
    for top in range(0, height, rows):
        start = sum(map(len, out))
        for c in range(channels):
            part = delta[c, top : top + rows].tobytes()
            part = part if raw else image_encode(part)
            out.append(struct.pack("<BI", raw, len(part)) + part)
        sizes.append(sum(map(len, out)) - start)
    return STRIPS + struct.pack("<BIII", channels, width, height, rows) + struct.pack(f"<{len(sizes)}I", *sizes) + b"".join(out)


# --- blocks: run-length and adaptive Golomb codes, colour transforms, predictors -----

#: For each of the four places of a period, how many of the 1,024 sums read 0, 1, ... 8 suffix bits.
SUFFIX_COUNTS = (
    (3, 7, 15, 27, 63, 108, 223, 448, 130),
    (3, 5, 13, 24, 51, 95, 192, 384, 257),
    (2, 5, 12, 21, 39, 86, 155, 320, 384),
    (2, 3, 9, 18, 33, 61, 129, 258, 511),
)
SUFFIX_BITS = [np.repeat(np.arange(9), counts).tolist() for counts in SUFFIX_COUNTS]
PERIOD = 4

#: For each transform, what red, green and blue take of the stored red, green and blue.
TRANSFORMS = np.array([
    [[1, 0, 0], [0, 1, 0], [0, 0, 1]],
    [[1, 1, 0], [0, 1, 0], [0, 1, 1]],
    [[1, 1, 1], [0, 1, 1], [0, 0, 1]],
    [[1, 0, 0], [1, 1, 0], [1, 1, 1]],
    [[2, 1, 1], [1, 1, 1], [1, 0, 1]],
    [[1, 0, 0], [1, 1, 1], [1, 0, 1]],
    [[1, 0, 0], [0, 1, 0], [0, 1, 1]],
    [[1, 0, 0], [0, 1, 1], [0, 0, 1]],
    [[1, 1, 0], [0, 1, 0], [0, 0, 1]],
    [[1, 0, 1], [1, 1, 1], [1, 1, 2]],
    [[1, 0, 0], [1, 1, 0], [1, 0, 1]],
    [[1, 0, 1], [0, 1, 1], [0, 0, 1]],
    [[1, 0, 1], [1, 1, 1], [0, 0, 1]],
    [[1, 1, 1], [1, 2, 1], [0, 1, 1]],
    [[2, 1, 1], [1, 1, 0], [1, 1, 1]],
    [[1, 0, 2], [0, 1, 2], [0, 0, 1]],
], np.uint8)


class Bits:
    """Bits of a byte string, lowest first, as one integer."""

    def __init__(self, data: bytes):
        self.value, self.at, self.end = int.from_bytes(data, "little"), 0, 8 * len(data)
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
        self.ones = np.append(np.flatnonzero(self.bits), 1 << 62)
        self.next_one = 0

    def zeros(self) -> int:
        """Zeros up to the next one, which is read too."""
        while self.ones[self.next_one] < self.at:
            self.next_one += 1
        one = int(self.ones[self.next_one])
        if one >= self.end:
            raise MalformedError("a code runs past its bits")
        n, self.at = one - self.at, one + 1
        return n

    def take(self, n: int) -> int:
        out = 0
        for k, bit in enumerate(self.bits[self.at : self.at + n].tolist()):
            out |= bit << k
        self.at += n
        return out

    def byte(self, at: int) -> int:
        return int(np.packbits(self.bits[8 * at : 8 * at + 8], bitorder="little")[0]) if 8 * at < self.end else 0


def read_residuals(data: bytes, count: int) -> np.ndarray:
    """count residuals: runs of zeros and of adaptive Golomb codes take turns."""
    out = np.zeros(count, np.uint8)
    bits = Bits(data)
    zero_run, place, total, left = not bits.take(1), 0, 0, PERIOD - 1
    while place < count:
        size = bits.zeros()
        run = min((1 << size) + bits.take(size), count - place)
        if zero_run:
            place += run
        for _ in range(0 if zero_run else run):
            word = bits.at // 8 * 8
            if not bits.bits[bits.at : word + 32].any():  # a prefix too long for a word is given as a byte
                prefix = bits.byte(bits.at // 8 + 4)
                bits.at = word + 40
            else:
                prefix = bits.zeros()
            suffix = SUFFIX_BITS[left][total]
            code = (prefix << suffix) + bits.take(suffix)
            magnitude = code >> 1
            out[place] = (magnitude + 1 if code & 1 else -magnitude - 1) & 0xFF
            place += 1
            total += magnitude
            left -= 1
            if left < 0:
                total, left = total >> 1, PERIOD - 1
        zero_run = not zero_run
    return out


def write_residuals(values: np.ndarray) -> tuple[bytes, int]:
    """(bytes, bits) that read_residuals reads back; codes of long prefixes use the byte form."""
    bits: list[int] = []
    put = lambda value, n: bits.extend(value >> k & 1 for k in range(n))
    values = values.astype(np.int64)
    signed = np.where(values > 127, values - 256, values)
    total, left, place, n = 0, PERIOD - 1, 0, len(values)
    put(int(n > 0 and signed[0] != 0), 1)
    while place < n:
        stop = place
        while stop < n and (signed[stop] != 0) == (signed[place] != 0):
            stop += 1
        run, size = stop - place, (stop - place).bit_length() - 1
        put(1 << size, size + 1)
        put(run - (1 << size), size)
        for v in signed[place:stop].tolist() if signed[place] else ():
            magnitude, low = abs(v) - 1, int(v > 0)
            code = magnitude << 1 | low
            suffix = SUFFIX_BITS[left][total]
            prefix = code >> suffix
            if prefix >= 32 - len(bits) % 8:
                bits.extend([0] * (32 - len(bits) % 8))
                put(prefix, 8)
            else:
                put(1 << prefix, prefix + 1)
            put(code & (1 << suffix) - 1, suffix)
            total += magnitude
            left -= 1
            if left < 0:
                total, left = total >> 1, PERIOD - 1
        place = stop
    raw = np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()
    return raw + bytes(8), len(bits) + 64


def filter_ring() -> bytes:
    """The ring that filter bytes are unpacked with: four of i and four of j for i < 32, j < 16."""
    return b"".join(bytes([i]) * 4 + bytes([j]) * 4 for i in range(32) for j in range(16))


def block_sources(width: int, top: int, tall: int) -> np.ndarray:
    """For each pixel of a group of rows, the place of its residual.

    Blocks follow one another; odd ones store their rows from the bottom up;
    even rows of the image are stored forwards, odd ones backwards.
    """
    out = np.empty((tall, width), np.int64)
    for column, left in enumerate(range(0, width, EDGE)):
        wide = min(EDGE, width - left)
        for row in range(tall):
            stored = tall - 1 - row if column & 1 else row
            place = left * tall + stored * wide + np.arange(wide)
            forwards = (top + row) % 2 == 0
            out[row, left : left + wide] = place if forwards else place[::-1]
    return out


def blocks_header(body: bytes) -> tuple[int, int, int, int, int, int, int]:
    """(channels, data flag, colour type, external table, width, height, longest pool in bits)."""
    return struct.unpack_from("<BBBBIII", body)


def read_filters(body: bytes) -> tuple[np.ndarray, int]:
    """(filter byte of each block, place after them)."""
    *_, width, height, _ = blocks_header(body)
    size = struct.unpack_from("<I", body, 16)[0]
    across, down = -(-width // EDGE), -(-height // EDGE)
    raw = ImageRing(filter_ring()).decode(body[20 : 20 + size], across * down)
    return np.frombuffer(raw, np.uint8).reshape(down, across), 20 + size


def decode_blocks(body: bytes) -> Image:
    channels, _, _, _, width, height, _ = blocks_header(body)
    if channels not in (3, 4):
        raise MalformedError(f"{channels} channels")
    filters, pos = read_filters(body)
    out = np.zeros((height, width, 4), np.uint8)
    start = np.array([0, 0, 0, 255 if channels == 3 else 0], np.int64)
    above = np.zeros((width, 4), np.int64)
    for group, top in enumerate(range(0, height, EDGE)):
        tall = min(EDGE, height - top)
        planes = np.zeros((4, tall * width), np.uint8)  # blue, green, red, alpha
        for c in range(channels):
            word = struct.unpack_from("<I", body, pos)[0]
            size = -(-(word & 0x3FFFFFFF) // 8)
            if word >> 30:
                raise MalformedError(f"pool method {word >> 30}")
            planes[c] = read_residuals(body[pos + 4 : pos + 4 + size], tall * width)
            pos += 4 + size
        placed = planes[:, block_sources(width, top, tall)]
        kind = np.repeat(filters[group], EDGE)[:width]
        if (kind >> 1).max(initial=0) >= len(TRANSFORMS):
            raise MalformedError("unknown colour transform")
        rgb = np.einsum("xij,jyx->yxi", TRANSFORMS[kind >> 1], placed[[2, 1, 0]], dtype=np.uint8, casting="unsafe")
        delta = np.concatenate([rgb, placed[3][:, :, None]], 2).astype(np.int64)
        for row in range(tall):
            above = predict_row(above, delta[row], kind & 1, start, channels)
            out[top + row] = above
    return width, height, out.tobytes()


def predict_row(above: np.ndarray, delta: np.ndarray, average: np.ndarray, start: np.ndarray, channels: int) -> np.ndarray:
    """One row from the one above it: the rounded mean of left and above, or the median predictor."""
    row = np.empty_like(above)
    left, corner = start, start
    for x in range(len(row)):
        up = above[x]
        if average[x]:
            guess = (left + up + 1) >> 1
        else:
            low, high = np.minimum(left, up), np.maximum(left, up)
            guess = np.where(corner < low, high, np.where(corner > high, low, left + up - corner))
        left = guess + delta[x] & 0xFF
        if channels == 3:
            left[3] = 255
        row[x], corner = left, up
    return row


def encode_blocks(width: int, height: int, pixels: bytes, channels: int = 4, filters: np.ndarray | None = None) -> bytes:
    """filters: a byte for each block, transform << 1 | average; any transform can be undone, as its determinant is 1."""
    image = np.frombuffer(pixels, np.uint8).reshape(height, width, 4).astype(np.int64)
    across, down = -(-width // EDGE), -(-height // EDGE)
    filters = np.zeros((down, across), np.uint8) if filters is None else filters.astype(np.uint8)
    start = np.array([0, 0, 0, 255 if channels == 3 else 0], np.int64)
    packed = image_encode(filters.tobytes())
    out, longest = [struct.pack("<I", len(packed)) + packed], 0
    above = np.zeros((width, 4), np.int64)
    back = np.array([np.rint(np.linalg.inv(t.astype(float))).astype(np.int64) for t in TRANSFORMS])
    for group, top in enumerate(range(0, height, EDGE)):
        tall = min(EDGE, height - top)
        kind = np.repeat(filters[group], EDGE)[:width]
        delta = np.empty((tall, width, 4), np.int64)
        for row in range(tall):
            here = image[top + row].copy()
            if channels == 3:
                here[:, 3] = 255
            left = np.vstack([start, here[:-1]])
            corner = np.vstack([start, above[:-1]])
            low, high = np.minimum(left, above), np.maximum(left, above)
            median = np.where(corner < low, high, np.where(corner > high, low, left + above - corner))
            guess = np.where((kind & 1)[:, None] == 1, (left + above + 1) >> 1, median)
            delta[row] = here - guess & 0xFF
            above = here
        stored = np.einsum("xij,yxj->yxi", back[kind >> 1], delta[:, :, :3]) & 0xFF
        planes = np.empty((4, tall * width), np.uint8)
        where = block_sources(width, top, tall)
        for c, plane in enumerate((stored[:, :, 2], stored[:, :, 1], stored[:, :, 0], delta[:, :, 3])):
            planes[c][where] = plane
        for c in range(channels):
            raw, n = write_residuals(planes[c])
            longest = max(longest, n)
            raw = raw.ljust(-(-n // 8), b"\0")
            out.append(struct.pack("<I", n) + raw[: -(-n // 8)])
    return BLOCKS + struct.pack("<BBBBIII", channels, 0, 0, 0, width, height, longest) + b"".join(out)
