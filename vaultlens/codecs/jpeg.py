"""A sequential (baseline) JPEG decoder: Huffman codes in Python, transforms in numpy.

Chroma of half size is enlarged by weights of 3 and 1, other sizes by repetition,
and the cosine transform is in floating point, so samples may differ by a few
steps from other decoders'.  Progressive,
lossless and arithmetic-coded files are not decoded.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from vaultlens.codecs.errors import MalformedError

EDGE = 8


def _zigzag() -> np.ndarray:
    """Place in a block, by rows, of each coefficient in the order in which they are stored."""
    cells = [(r, c) for r in range(EDGE) for c in range(EDGE)]
    cells.sort(key=lambda rc: (rc[0] + rc[1], rc[0] if (rc[0] + rc[1]) % 2 else rc[1]))
    return np.array([r * EDGE + c for r, c in cells])


ZIGZAG = _zigzag()
_k = np.arange(EDGE)
BASIS = np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16) / 2
BASIS[0] /= np.sqrt(2)


@dataclass
class Component:
    id: int
    across: int
    down: int
    table: int
    dc: dict = field(default_factory=dict)
    ac: dict = field(default_factory=dict)
    blocks: list = field(default_factory=list)


class Bits:
    """Bits of one run between restart marks, highest first, taken in a few bytes at a time."""

    STEP = 64

    def __init__(self, data: bytes):
        self.raw, self.pos = data.replace(b"\xff\0", b"\xff") + b"\xff" * 4, 0
        self.value = self.left = 0

    def take(self, n: int) -> int:
        if self.left < n:
            part = self.raw[self.pos : self.pos + self.STEP]
            if not part:
                raise MalformedError("the scan ends early")
            self.value = (self.value & (1 << self.left) - 1) << 8 * len(part) | int.from_bytes(part, "big")
            self.left += 8 * len(part)
            self.pos += self.STEP
        self.left -= n
        return self.value >> self.left & (1 << n) - 1

    def code(self, table: dict[tuple[int, int], int]) -> int:
        word = 0
        for n in range(1, 17):
            word = word << 1 | self.take(1)
            if (n, word) in table:
                return table[n, word]
        raise MalformedError("no such code")

    def number(self, n: int) -> int:
        """A signed number of n bits: without its first bit it is negative."""
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol; codes of one length are consecutive."""
    out, code, at = {}, 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            out[n, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def read_block(bits: Bits, c: Component, before: int) -> tuple[list[int], int]:
    block = [0] * 64
    block[0] = before + bits.number(bits.code(c.dc))
    k = 1
    while k < 64:
        symbol = bits.code(c.ac)
        run, size = symbol >> 4, symbol & 15
        if not size:
            if run < 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise MalformedError("a block of more than 64 coefficients")
        block[k] = bits.number(size)
        k += 1
    return block, block[0]


def planes(blocks: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Samples of blocks of stored coefficients."""
    square = np.zeros((len(blocks), 64))
    square[:, ZIGZAG] = blocks * table
    samples = BASIS.T @ square.reshape(-1, EDGE, EDGE) @ BASIS
    return np.clip(np.rint(samples + 128), 0, 255).astype(np.uint8)


def enlarged(plane: np.ndarray, by: int, axis: int) -> np.ndarray:
    """Twice the size by weighting each sample 3 to 1 with its nearer neighbour; other sizes by repetition."""
    if by != 2:
        return plane.repeat(by, axis)
    wide = np.moveaxis(plane, axis, 0).astype(np.int64)
    pad = np.concatenate([wide[:1], wide, wide[-1:]])
    out = np.empty((2 * len(wide), *wide.shape[1:]), np.int64)
    out[0::2], out[1::2] = (3 * wide + pad[:-2] + 1) // 4, (3 * wide + pad[2:] + 2) // 4
    return np.moveaxis(out, 0, axis).astype(np.uint8)


def decode(data: bytes) -> tuple[int, int, int, bytes]:
    """(width, height, channels, samples): 1 channel of grey or 3 of red, green and blue."""
    if data[:2] != b"\xff\xd8":
        raise MalformedError("no JPEG")
    tables, codes, frame, adobe, restart, pos = {}, {}, None, None, 0, 2
    try:
        while True:
            while data[pos] == 0xFF and data[pos + 1] == 0xFF:
                pos += 1
            mark, size = data[pos + 1], struct.unpack_from(">H", data, pos + 2)[0]
            if data[pos] != 0xFF:
                raise MalformedError(f"no mark at {pos}")
            body, pos = data[pos + 4 : pos + 2 + size], pos + 2 + size
            if mark == 0xDB:
                while body:
                    wide = body[0] >> 4
                    tables[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(float)
                    body = body[129 if wide else 65 :]
            elif mark == 0xC4:
                while body:
                    n = sum(body[1:17])
                    codes[body[0]] = huffman(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif mark in (0xC0, 0xC1):
                depth, height, width, n = struct.unpack_from(">BHHB", body)
                if depth != 8 or n not in (1, 3, 4):
                    raise MalformedError(f"{n} components of {depth} bits")
                frame = [Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * n, 3)]
            elif mark in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise MalformedError(f"frames of kind {mark - 0xC0} aren't decoded")
            elif mark == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif mark == 0xEE and body[:5] == b"Adobe":
                adobe = body[11]
            elif mark == 0xDA:
                break
        if not frame or body[0] != len(frame):
            raise MalformedError("scans of single components aren't decoded")
        by_id = {c.id: c for c in frame}
        for k in range(1, 1 + 2 * body[0], 2):
            by_id[body[k]].dc, by_id[body[k]].ac = codes[body[k + 1] >> 4], codes[16 + (body[k + 1] & 15)]
        across, down = max(c.across for c in frame), max(c.down for c in frame)
        if len(frame) == 1:
            frame[0].across = frame[0].down = across = down = 1
        wide, tall = -(-width // (EDGE * across)), -(-height // (EDGE * down))
        runs = scan_runs(data[pos:])
        for first in range(0, wide * tall, restart or wide * tall):
            bits, before = Bits(next(runs)), [0] * len(frame)
            for _ in range(min(restart or wide * tall, wide * tall - first)):
                for k, c in enumerate(frame):
                    for _ in range(c.across * c.down):
                        block, before[k] = read_block(bits, c, before[k])
                        c.blocks.append(block)
        channels = []
        for c in frame:
            samples = planes(np.array(c.blocks, float), tables[c.table])
            samples = samples.reshape(tall, wide, c.down, c.across, EDGE, EDGE).transpose(0, 2, 4, 1, 3, 5)
            plane = samples.reshape(tall * c.down * EDGE, wide * c.across * EDGE)
            plane = plane[: -(-height * c.down // down), : -(-width * c.across // across)]
            plane = enlarged(enlarged(plane, down // c.down, 0), across // c.across, 1)
            channels.append(plane[:height, :width])
    except (IndexError, struct.error, KeyError, StopIteration, ValueError) as e:
        raise e if isinstance(e, MalformedError) else MalformedError(f"JPEG: {type(e).__name__} {e}") from None
    return colours(channels, width, height, adobe)


def scan_runs(data: bytes):
    """The coded bytes between restart marks, up to any other mark."""
    start = pos = 0
    while (pos := data.find(b"\xff", pos)) >= 0 and pos + 1 < len(data):
        mark = data[pos + 1]
        if 0xD0 <= mark <= 0xD7:
            yield data[start:pos]
            start = pos + 2
        elif mark:
            break
        pos += 2
    yield data[start : pos if pos >= 0 else len(data)]


def colours(channels: list[np.ndarray], width: int, height: int, adobe: int | None) -> tuple[int, int, int, bytes]:
    if len(channels) == 1:
        return width, height, 1, channels[0].tobytes()
    c = np.stack(channels, 2).astype(float)
    if (len(channels) == 3 and adobe != 0) or adobe == 2:
        y, cb, cr = c[:, :, 0], c[:, :, 1] - 128, c[:, :, 2] - 128
        c[:, :, :3] = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
    rgb = np.clip(c[:, :, :3], 0, 255)
    if len(channels) == 4:  # inks, stored inverted by Adobe's writers
        if adobe is None:
            rgb, c = 255 - rgb, 255 - c
        rgb = rgb * np.clip(c[:, :, 3:], 0, 255) / 255
    return width, height, 3, np.rint(rgb).astype(np.uint8).tobytes()


def decode_bgr(data: bytes) -> tuple[int, bytes]:
    """(channels, samples) as layer images want them: grey, or blue, green and red."""
    width, height, channels, samples = decode(data)
    if channels == 3:
        samples = np.frombuffer(samples, np.uint8).reshape(-1, 3)[:, ::-1].tobytes()
    return channels, samples
