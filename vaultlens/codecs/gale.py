"""The layer-based image codec: a binary header (versions 103 to 107) or a packed XML one.

decode() gives (width, height, "RGB" or "RGBA", bytes) of the first frame's
first layer.  JPEG planes are decoded by codecs.jpeg unless another decoder is
handed in.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from xml.etree import ElementTree

import numpy as np

from vaultlens.codecs.errors import MalformedError
from vaultlens.codecs.jpeg import decode_bgr
from vaultlens.codecs.prng import permutation

PREFIX, XML_PREFIX = b"Gale", b"GaleX200"
ZLIB, RAW, JPEG = range(3)
DEPTHS = (4, 8, 16, 24, 32)

#: payload -> (channels in BGR or grey order, bytes)
JpegDecoder = Callable[[bytes], tuple[int, bytes]]


class UnsupportedError(MalformedError):
    """A variant that can't be decoded with what was given."""


@dataclass
class Layer:
    pixels: bytes
    alpha: bytes | None


@dataclass
class Frame:
    width: int
    height: int
    depth: int
    palette: list[tuple[int, int, int]]
    layers: list[Layer] = field(default_factory=list)
    stride: int = 0

    def __post_init__(self):
        self.stride = -(-self.width * self.depth // 8)
        if self.depth >= 8:
            self.stride = -(-self.stride // 4) * 4


@dataclass
class Header:
    version: int
    width: int
    height: int
    depth: int
    frames: int
    shuffled: bool
    compression: int
    mask: int
    block_width: int
    block_height: int
    data_offset: int

    def check(self) -> Header:
        if self.compression not in (ZLIB, RAW, JPEG):
            raise MalformedError(f"compression {self.compression}")
        if self.depth not in DEPTHS:
            raise MalformedError(f"{self.depth} bits a pixel")
        if self.frames < 1:
            raise MalformedError(f"{self.frames} frames")
        return self


class Reader:
    """Fields one after another; ends early with an error."""

    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos = data, pos

    def bytes(self, n: int) -> bytes:
        part = self.data[self.pos : self.pos + n]
        if n < 0 or len(part) < n:
            raise MalformedError("image ends early")
        self.pos += n
        return part

    def int(self, form: str = "<i") -> int:
        return struct.unpack(form, self.bytes(struct.calcsize(form)))[0]

    def sized(self) -> bytes:
        return self.bytes(self.int())


def binary_header(data: bytes) -> Header:
    if len(data) < 11 or data[:4] != PREFIX:
        raise MalformedError("no image magic")
    if not re.fullmatch(rb"\d{3}", data[4:7]):
        raise MalformedError(f"version {data[4:7]!r}")
    version, size = int(data[4:7]), struct.unpack_from("<I", data, 7)[0]
    if not 103 <= version <= 107:
        raise UnsupportedError(f"version {version}")
    if not 0x28 <= size <= 0x100 or 11 + size > len(data):
        raise MalformedError(f"header of {size} bytes")
    again, width, height, depth, frames, _, shuffled, compression, mask, bw, bh = struct.unpack_from("<iIIiiBBBxIii", data, 11)
    if again != version:
        raise MalformedError(f"version {version} in the magic, {again} in the header")
    return Header(version, width, height, depth, frames, shuffled != 0, compression, mask, bw, bh, 11 + size).check()


def xml_header(data: bytes) -> tuple[Header, ElementTree.Element]:
    size = struct.unpack_from("<I", data, 8)[0] if len(data) >= 12 else 0
    if not size or 12 + size > len(data):
        raise MalformedError(f"header of {size} bytes")
    try:
        text = zlib.decompress(data[12 : 12 + size])
        root = ElementTree.fromstring(re.sub(rb"<Frame [^>]+>", b"<Frame>", text))  # attributes may be repeated there
    except (zlib.error, ElementTree.ParseError) as e:
        raise MalformedError(str(e)) from None
    if root.tag != "Frames":
        raise MalformedError(f"root element {root.tag}")
    get = lambda name, default=None: int(root.attrib[name] if default is None else root.attrib.get(name, default))
    try:
        header = Header(
            get("Version"), get("Width"), get("Height"), get("Bpp"), get("Count"), root.attrib.get("Randomized", "0") != "0", get("CompType"),
            get("BGColor", "0") & 0xFFFFFFFF, get("BlockWidth"), get("BlockHeight"), 12 + size,
        )
    except (KeyError, ValueError) as e:
        raise MalformedError(f"header attribute {e}") from None
    return header.check(), root


def xml_palette(text: str, depth: int) -> list[tuple[int, int, int]]:
    """RRGGBB after one another, short ones filled up with black."""
    raw = bytes.fromhex(text.strip()[: len(text.strip()) // 6 * 6])
    colours = [tuple(raw[i : i + 3]) for i in range(0, len(raw), 3)][: 1 << depth]
    return colours + [(0, 0, 0)] * ((1 << depth) - len(colours))


def read_plane(source: bytes, frame: Frame, alpha: bool, header: Header, key: int) -> bytes:
    """Rows of a layer, plain or in blocks that may repeat earlier ones."""
    depth = 8 if alpha else frame.depth
    stride = -(-frame.width // 4) * 4 if alpha else frame.stride
    if header.block_width <= 0 or header.block_height <= 0:
        rows = np.frombuffer(source[: stride * frame.height].ljust(stride * frame.height, b"\0"), np.uint8).reshape(frame.height, stride)
        if header.shuffled:
            out = np.empty_like(rows)
            out[permutation(frame.height, key)] = rows
            rows = out
        return rows.tobytes()
    across, down = -(-frame.width // header.block_width), -(-frame.height // header.block_height)
    n = across * down
    if 8 * n > len(source):
        raise MalformedError("the block table ends early")
    refs = np.frombuffer(source, "<i4", 2 * n).reshape(n, 2)
    if header.shuffled:
        out = np.empty_like(refs)
        out[permutation(n, key)] = refs
        refs = out
    plane, reader = np.zeros((frame.height, stride), np.uint8), Reader(source, 8 * n)

    def box(k: int, like: int) -> tuple[slice, slice]:
        """Block k's bytes, in the shape of block `like`."""
        x, y = k % across * header.block_width, k // across * header.block_height
        wide = min(header.block_width, frame.width - like % across * header.block_width)
        tall = min(header.block_height, frame.height - like // across * header.block_height)
        left = -(-x * depth // 8)
        return slice(y, y + tall), slice(left, left + -(-wide * depth // 8))

    for k, (which, layer) in enumerate(refs.tolist()):
        to = box(k, k)
        shape = plane[to].shape
        if which == -1:
            plane[to] = np.frombuffer(reader.bytes(shape[0] * shape[1]), np.uint8).reshape(shape)
        elif which == -2:
            part = plane[box(layer, k)]
            plane[to] = part if part.shape == shape else np.zeros(shape, np.uint8)
        else:
            raise MalformedError(f"block refers to frame {which}, layer {layer}")  # only the first frame is read
    return plane.tobytes()


def read_layer(payload: bytes, frame: Frame, alpha: bool, header: Header, key: int, jpeg: JpegDecoder) -> bytes:
    if header.compression == RAW:
        return read_plane(payload, frame, alpha, header, key)
    if header.compression == ZLIB or alpha:
        try:
            return read_plane(zlib.decompress(payload), frame, alpha, header, key)
        except zlib.error as e:
            raise MalformedError(str(e)) from None
    channels, pixels = jpeg(payload)
    frame.depth, frame.stride = 8 * channels, frame.width * channels
    return pixels


def binary_frame(data: bytes, header: Header, key: int, jpeg: JpegDecoder) -> Frame:
    r = Reader(data, header.data_offset)
    r.bytes(r.int("<I"))  # name
    r.bytes(13)  # mask, reserved
    layers, width, height, depth = (r.int() for _ in range(4))
    if layers < 1 or depth <= 0:
        raise MalformedError(f"{layers} layers, {depth} bits a pixel")
    palette = []
    if depth <= 8:
        raw = np.frombuffer(r.bytes(4 << depth), np.uint8).reshape(-1, 4)
        palette = [tuple(c) for c in raw[:, [2, 1, 0]].tolist()]
    frame = Frame(width, height, depth, palette)
    for _ in range(layers):
        r.bytes(18)  # left, top, visible, transparent colour, alpha, alpha on
        r.bytes(r.int("<I"))  # name
        if header.version >= 107:
            r.bytes(1)  # locked
        pixels = read_layer(r.sized(), frame, False, header, key, jpeg)
        packed = r.sized()
        frame.layers.append(Layer(pixels, read_layer(packed, frame, True, header, key, jpeg) if packed else None))
    return frame


def xml_frame(data: bytes, header: Header, root: ElementTree.Element, key: int, jpeg: JpegDecoder) -> Frame:
    node = root.find("Frame/Layers")
    if node is None:
        raise MalformedError("no layers in the header")
    try:
        width, height, depth = (int(node.attrib[a]) for a in ("Width", "Height", "Bpp"))
    except KeyError as e:
        raise MalformedError(f"layer attribute {e}") from None
    frame = Frame(width, height, depth, xml_palette(node.findtext("RGB") or "", depth) if depth <= 8 else [])
    r = Reader(data, header.data_offset)
    for layer in node.findall("Layer"):
        pixels = read_layer(r.sized(), frame, False, header, key, jpeg)
        alpha = read_layer(r.sized(), frame, True, header, key, jpeg) if layer.attrib.get("AlphaOn", "0") != "0" else None
        frame.layers.append(Layer(pixels, alpha))
    return frame


def flatten(frame: Frame) -> tuple[int, int, str, bytes]:
    """The first layer as RGB, or RGBA if it has an alpha plane."""
    if not frame.layers:
        raise MalformedError("no layers")
    layer, w, h = frame.layers[0], frame.width, frame.height
    rows = np.frombuffer(layer.pixels[: frame.stride * h].ljust(frame.stride * h, b"\0"), np.uint8).reshape(h, frame.stride)
    if frame.depth in (24, 32):
        n = frame.depth // 8
        rgb = rows[:, : w * n].reshape(h, w, n)[:, :, [2, 1, 0]]
    elif frame.depth == 16:
        word = rows[:, : 2 * w].copy().view("<u2").astype(np.int64)
        rgb = np.stack([(word & m) * 255 // m for m in (0xF800, 0x07E0, 0x001F)], 2).astype(np.uint8)
    elif frame.depth in (4, 8):
        if frame.depth == 8:
            index = rows[:, :w]
        else:
            index = np.stack([rows & 15, rows >> 4], 2).reshape(h, -1)[:, :w]
        palette = np.array(frame.palette or np.zeros((0, 3)), np.uint8).reshape(-1, 3)
        if not len(palette) and index.size or index.max(initial=0) >= max(1, len(palette)):
            raise MalformedError("a colour is not in the palette")
        rgb = palette[index] if index.size else np.zeros((h, w, 3), np.uint8)
    else:
        raise MalformedError(f"{frame.depth} bits a pixel")
    if layer.alpha is None:
        return w, h, "RGB", np.ascontiguousarray(rgb).tobytes()
    stride = -(-w // 4) * 4
    alpha = np.frombuffer(layer.alpha, np.uint8).reshape(h, stride)[:, :w, None]
    return w, h, "RGBA", np.concatenate([rgb, alpha], 2).tobytes()


def decode(data: bytes, key: int = 0, jpeg: JpegDecoder = decode_bgr) -> tuple[int, int, str, bytes]:
    packed = data[:8] == XML_PREFIX
    header, root = xml_header(data) if packed else (binary_header(data), None)
    if header.shuffled and not key:
        raise UnsupportedError("shuffled images need their key")
    return flatten(xml_frame(data, header, root, key, jpeg) if packed else binary_frame(data, header, key, jpeg))


def encode(width: int, height: int, depth: int, rows: bytes, alpha: bytes | None = None, version: int = 105, palette: bytes = b"", key: int = 0, compression: int = ZLIB) -> bytes:
    """One frame of one layer; rows and alpha padded as Frame says, rows shuffled if there is a key."""

    def plane(raw: bytes) -> bytes:
        if key:
            split = np.frombuffer(raw, np.uint8).reshape(height, -1)
            raw = split[permutation(height, key)].tobytes()
        return zlib.compress(raw) if compression == ZLIB else raw

    head = struct.pack("<iIIiiBBBxIii", version, width, height, depth, 1, 0, bool(key), compression, 0, 0, 0).ljust(0x28, b"\0")
    out = PREFIX + b"%03d" % version
    out += struct.pack("<I", len(head)) + head + struct.pack("<I", 0) + bytes(13) + struct.pack("<4i", 1, width, height, depth) + palette
    out += bytes(18) + struct.pack("<I", 0) + (b"\0" if version >= 107 else b"")
    body = plane(rows)
    out += struct.pack("<i", len(body)) + body
    cover = plane(alpha) if alpha is not None else b""
    return out + struct.pack("<i", len(cover)) + cover
