"""EXIF dates, makers and models of images, read where the files are reached."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rules import EXIF_EXTENSIONS

# Fixed values of the TIFF and EXIF formats.
MAKE, MODEL, DATE_TIME, ASCII = 0x010F, 0x0110, 0x0132, 2
SCHEMA = "abs_path string, year string, month string, day string, make string, model string"
#: EXIF stands near the start of a file; this many bytes are searched.
HEAD = 1 << 18


def _tiff(data: bytes) -> bytes | None:
    """The TIFF block of a JPEG, PNG, HEIC or TIFF file."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size = struct.unpack(">I", data[at : at + 4])[0]
            if data[at + 4 : at + 8] == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
        return None
    at = data.find(b"Exif\0\0")
    return data[at + 6 :] if at >= 0 else None


def parse(data: bytes) -> dict[str, str] | None:
    """year, month, day, make and model, as far as they are there; null if the image has no EXIF."""
    tiff = _tiff(data)
    if not tiff or tiff[:4] not in (b"II*\0", b"MM\0*"):
        return None
    order = "<" if tiff[:2] == b"II" else ">"
    try:
        start = struct.unpack(order + "I", tiff[4:8])[0]
        n = struct.unpack(order + "H", tiff[start : start + 2])[0]
        found: dict[str, str] = {}
        for i in range(n):
            at = start + 2 + 12 * i
            tag, kind, count = struct.unpack(order + "HHI", tiff[at : at + 8])
            if tag not in (MAKE, MODEL, DATE_TIME) or kind != ASCII:
                continue
            where = at + 8 if count <= 4 else struct.unpack(order + "I", tiff[at + 8 : at + 12])[0]
            text = tiff[where : where + count].split(b"\0")[0].decode("utf-8", "replace").strip()
            if tag == DATE_TIME:
                parts = text.split(" ")[0].replace("-", ":").split(":")
                if len(parts) >= 3:
                    found |= dict(zip(("year", "month", "day"), parts))
            elif text:
                found["make" if tag == MAKE else "model"] = text
        return found
    except struct.error:
        return None


def read(files: DataFrame, path: str = "abs_path") -> DataFrame:
    """(abs_path, year, month, day, make, model) of the images among files that have EXIF; others are not opened."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p in batch["abs_path"]:
                try:
                    with open(p, "rb") as f:
                        found = parse(f.read(HEAD))
                except OSError:
                    found = None
                if found is not None:
                    out.append({"abs_path": p, **found})
            yield pd.DataFrame(out, columns=["abs_path", "year", "month", "day", "make", "model"], dtype=object)

    images = files.where(F.lower("extension").isin(*EXIF_EXTENSIONS)).select(F.col(path).alias("abs_path"))
    return images.mapInPandas(run, SCHEMA)
