"""Predicates and projections over member and file paths."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Plugin files that have nothing to do with encryption.
UTILITY_PLUGINS = (
    "csvparser.tpm", "extrans.tpm", "fstat.tpm", "layereximage.tpm", "windowex.tpm", "wumsadp.tpm", "wuvorbis.tpm",
    "menu.tpm", "wutcwf.tpm", "kratimer.tpm", "krflash.tpm", "krmovie.tpm", "ksupport.tpm", "wumsmpeg.tpm",
)
#: Programs that don't make a folder a game's.
GENERIC_PROGRAMS = (
    "directx_jun2010_redist.exe", "dxsetup.exe", "dxwebsetup.exe", "python.exe", "pythonw.exe",
    "setup.exe", "uninstall.exe", "unins000.exe", "zsync.exe", "zsyncmake.exe",
)
#: Extension -> first bytes, in the order in which they are tried.
SIGNATURES = {
    ".png": b"\x89PNG", ".bmp": b"BM", ".wav": b"RIFF", ".ogg": b"OggS", ".jpg": b"\xff\xd8\xff", ".jpeg": b"\xff\xd8\xff",
}


def glob(name: Column, pattern: str | None) -> Column:
    """Shell pattern over the whole name, in which * crosses separators; None fits all."""
    if pattern is None:
        return F.lit(True)
    body = fnmatch.translate(pattern)
    body = re.sub(r"^\(\?s:(.*)\)\\[zZ]$", r"\1", body)
    return name.rlike(rf"(?s)\A(?:{body})\z")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(name: Column) -> Column:
    """Lower case with its dot; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(base_name(name), r"[^.].*?(\.[^.]*)$", 1))


def is_utility_plugin(path: Column) -> Column:
    return F.lower(base_name(path)).isin(*UTILITY_PLUGINS)


def is_patch(path: Column) -> Column:
    return base_name(path).startswith("patch")


def publisher_and_game(path: Column) -> Column:
    """The first two parts of a relative path."""
    parts = F.split(path, "/")
    return F.struct(F.get(parts, F.lit(0)).alias("publisher"), F.get(parts, F.lit(1)).alias("game"))


def to_slashes(name: Column) -> Column:
    return F.replace(name, F.lit("\\"), F.lit("/"))


def to_backslashes(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("\\"))


def safe_path(name: Column) -> Column:
    """The name below an output folder: slashes, no drive, no empty, ``.`` or ``..`` parts."""
    parts = F.split(F.regexp_replace(to_slashes(name), r"^[A-Za-z]:", ""), "/")
    return F.array_join(F.filter(parts, lambda p: ~p.isin("", ".", "..")), "/")


def has_signature(data: Column, ext: Column) -> Column:
    """Whether bytes begin as their extension says; a PNG of 16 bytes or more has its header chunk next."""
    fits = F.lit(False)
    for e, magic in reversed(SIGNATURES.items()):
        ok = F.startswith(data, F.lit(magic))
        if e == ".png":
            ok = ok & ((F.octet_length(data) < 16) | (F.substring(data, 13, 4) == F.lit(b"IHDR")))
        fits = F.when(ext == e, ok).otherwise(fits)
    return F.coalesce(fits, F.lit(False))


def signature_extension(name: Column) -> Column:
    """The extension of SIGNATURES that the name ends with; null without."""
    lower = F.lower(name)
    return F.coalesce(*(F.when(lower.endswith(e), F.lit(e)) for e in SIGNATURES))


def identify_format(path: Column, head: Column, tail: Column) -> Column:
    """Format by the file's first and last bytes, then by extension; null if unknown."""
    from vaultlens.formats import vf, xp3

    embedded = F.startswith(head, F.lit(b"MZ")) & F.endswith(tail, F.lit(vf.TRAILER_TAG))
    by_name = F.create_map(*(F.lit(x) for x in (".det", "det", ".gsp", "gsp", ".arc", "arc")))
    return (
        F.when(F.startswith(head, F.lit(xp3.MAGIC)), "xp3")
        .when(F.startswith(head, F.lit(vf.MAGIC)) | embedded, "vf")
        .otherwise(F.try_element_at(by_name, extension(path)))
    )
