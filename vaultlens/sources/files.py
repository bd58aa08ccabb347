"""Members to files: extraction with safe paths, statuses instead of warnings, images as PNG, texts decoded."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.codecs import ciphers, gale, png, tlg
from vaultlens.codecs.errors import MalformedError
from vaultlens.functions.bytes import decode_image
from vaultlens.functions.paths import safe_path

EXTRACTED = "archive string, file_name string, path string, status string, reason string"
IMAGE_EXTENSIONS = {".tlg", ".gal"}


def converted(name: str, data: bytes, images: bool, text: bool) -> tuple[str, bytes, str | None]:
    """(name, bytes, why it stayed as it was): images become PNG, framed texts plain UTF-16, where that works."""
    stem, ext = os.path.splitext(name)
    if images and ext.lower() in IMAGE_EXTENSIONS and data[:4] in (gale.PREFIX, *(m[:4] for m in (tlg.CONTAINER, tlg.STRIPS, tlg.BLOCKS))):
        picture = decode_image(data)
        if picture["pixels"] is None:
            return name, data, picture["error"]
        return stem + ".png", png.encode(picture["width"], picture["height"], picture["mode"], picture["pixels"]), None
    if text and data[:2] == ciphers.FRAME:
        try:
            return name, ciphers.text_decode(data), None
        except MalformedError as e:
            return name, data, str(e)
    return name, data, None


def extract(payloads: DataFrame, root: str, images: bool = False, text: bool = True, below: str | None = None) -> DataFrame:
    """EXTRACTED of payloads (archive, file_name, data, status): new files below root/archive, which all executors must have mounted.

    Archives below the folder ``below`` keep their places in it, so that those of one name stay apart.

    Statuses: written, kept as it was (with a reason), exists, name too long, or
    the payload's own.  Files appear whole, under their names, or not at all.
    """
    root = root.removeprefix("file://")
    base = F.regexp_replace(F.regexp_extract("archive", "([^/]*)$", 1), r"\.[^.]*$", "")
    if below is not None:
        path, top = F.regexp_replace("archive", "^[a-z]+:/*", "/"), os.path.abspath(below).rstrip("/") + "/"
        inner = F.regexp_replace(F.substring(path, F.lit(len(top) + 1), F.length(path)), r"\.[^./]*$", "")
        base = F.when(F.startswith(path, F.lit(top)), inner).otherwise(base)
    placed = payloads.withColumn("_place", F.concat_ws("/", safe_path(base), safe_path(F.col("file_name"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for archive, name, place, data, status in zip(b.archive, b.file_name, b._place, b["data"], b.status, strict=True):
                if status != "ok":
                    rows.append((archive, name, None, status, None))
                    continue
                place, content, reason = converted(place, data, images, text)
                path = os.path.join(root, place)
                try:
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    temporary = os.path.join(os.path.dirname(path), f".{os.getpid()}.part")
                    with open(temporary, "wb") as f:
                        f.write(content)
                    try:
                        os.link(temporary, path)
                        outcome = "kept as it was" if reason else "written"
                    except FileExistsError:
                        outcome = "exists"
                    finally:
                        os.remove(temporary)
                except OSError as e:
                    outcome, reason = "name too long" if e.errno == 36 else "failed", e.strerror
                rows.append((archive, name, path, outcome, reason))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in EXTRACTED.split(", ")])

    return placed.select("archive", "file_name", "_place", "data", "status").mapInPandas(run, EXTRACTED)


def failure_report(results: DataFrame) -> DataFrame:
    """One JSON text a row, of the rows that weren't written."""
    return results.where("status != 'written'").select(F.to_json(F.struct(*results.columns)).alias("value"))
