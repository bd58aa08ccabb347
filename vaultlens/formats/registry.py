"""Formats by name, identification by magic, and reading members alike for all of them."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from importlib.metadata import entry_points

from vaultlens.codecs.errors import MalformedError
from vaultlens.formats import arc, det, gsp, vf, xp3
from vaultlens.formats.model import Entry


@dataclass(frozen=True)
class Format:
    """parse(content) and read(content, entry, archive path, options); build(members, options) and matches(path, head, tail) if there are."""

    name: str
    parse: Callable[..., list[Entry]]
    read: Callable[..., bytes]
    build: Callable[..., bytes] | None = None
    matches: Callable[[str, bytes, bytes], bool] | None = None


def _vf_stream(data: bytes) -> bytes:
    return data[vf.base_offset(data) :]


FORMATS: dict[str, Format] = {
    "xp3": Format("xp3", xp3.parse, lambda d, e, a, o: xp3.read(d, e, o.get("scheme"), o.get("parameters"), o.get("force", False))),
    "gsp": Format("gsp", gsp.parse, lambda d, e, a, o: gsp.read(d, e, o.get("decrypt", True))),
    "arc": Format("arc", arc.parse, lambda d, e, a, o: arc.read(d, e, a, o.get("decrypt", True))),
    "vf": Format("vf", lambda d: vf.parse(_vf_stream(d)), lambda d, e, a, o: vf.read(_vf_stream(d), e, o.get("check", False))),
    "det": Format("det", lambda d: det.parse(unbundle(d)), lambda d, e, a, o: det.read(unbundle(d)["det"], e, o.get("check", False))),
}
EXTENSIONS = {".det": "det", ".gsp": "gsp", ".arc": "arc"}


BUILT_IN = frozenset(FORMATS)
#: Entry points of this group are functions without arguments that call register_format.
GROUP = "vaultlens.formats"


def register_format(name: str, parse: Callable[..., list[Entry]], read: Callable[..., bytes], build: Callable[..., bytes] | None = None, matches: Callable[[str, bytes, bytes], bool] | None = None) -> None:
    """Add a format that archives are then scanned, read, written (build) and recognised (matches) in; an older one of that name goes."""
    FORMATS[name] = Format(name, parse, read, build, matches)


def discover(group: str = GROUP) -> list[str]:
    """Load what installed packages offer under an entry-point group; their names."""
    found = sorted(entry_points(group=group), key=lambda e: e.name)
    for e in found:
        e.load()()
    return [e.name for e in found]


def added() -> list[Format]:
    return [f for n, f in FORMATS.items() if n not in BUILT_IN and f.matches]


def identify(path: str, head: bytes, tail: bytes) -> str | None:
    """By the first 16 and last 6 bytes, then by extension, then as added formats say."""
    if head.startswith(xp3.MAGIC):
        return "xp3"
    if head.startswith(vf.MAGIC) or head.startswith(b"MZ") and tail.endswith(vf.TRAILER_TAG):
        return "vf"
    known = EXTENSIONS.get(os.path.splitext(path)[1].lower())
    return known or next((f.name for f in added() if f.matches(path, head, tail)), None)


def bundle(files: dict[str, bytes]) -> bytes:
    """Companion files as one value: a line of names and sizes, then their bytes."""
    head = ",".join(f"{k}:{len(v)}" for k, v in files.items())
    return head.encode() + b"\n" + b"".join(files.values())


def unbundle(data: bytes) -> dict[str, bytes]:
    line, _, rest = data.partition(b"\n")
    out, at = {}, 0
    try:
        for part in line.decode().split(","):
            name, size = part.split(":")
            out[name], at = rest[at : at + int(size)], at + int(size)
    except ValueError:
        raise MalformedError("no companion files") from None
    return out


def find(entries: list[Entry], name: str) -> Entry:
    """The first entry of that name."""
    for e in entries:
        if e.file_name == name:
            return e
    raise KeyError(name)
