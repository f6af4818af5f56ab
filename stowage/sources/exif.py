"""What cameras write into pictures, as a map of names to texts."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the Exif standard: tags that are read, bytes of a value of each type, and tags that lead to further directories.
TAGS = {
    0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright",
    0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "PhotographicSensitivity", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9010: "OffsetTime",
    0x9011: "OffsetTimeOriginal", 0x920A: "FocalLength", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension", 0xA433: "LensMake", 0xA434: "LensModel",
}
WIDTHS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
NUMBERS = {1: "B", 3: "H", 4: "I", 9: "i"}
DEEPER = (0x8769, 0x8825)
#: First bytes of a file that are searched.
HEAD = 64 * 1024


def _tiff(head: bytes) -> bytes:
    """The directory structure within a picture's first bytes."""
    if head[:4] in (b"II*\0", b"MM\0*"):
        return head
    at = 2
    while head[:2] == b"\xff\xd8" and at + 4 <= len(head) and head[at] == 0xFF:
        mark, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        if mark == 0xE1 and head[at + 4 : at + 10] == b"Exif\0\0":
            return head[at + 10 : at + 2 + size]
        if mark == 0xDA or size < 2:
            break
        at += 2 + size
    return b""


def read_exif(head: bytes | None) -> dict[str, str]:
    """Names and values of the first picture of a JPEG or TIFF file; none where they can't be read."""
    data = _tiff(bytes(head or b""))
    if len(data) < 8:
        return {}
    end = "<" if data[:2] == b"II" else ">"
    out: dict[str, str] = {}
    todo, seen = [struct.unpack_from(end + "I", data, 4)[0]], set()
    while todo:
        at = todo.pop(0)
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        for k in range(struct.unpack_from(end + "H", data, at)[0]):
            entry = at + 2 + 12 * k
            if entry + 12 > len(data):
                break
            tag, kind, count = struct.unpack_from(end + "HHI", data, entry)
            size = WIDTHS.get(kind, 0) * count
            start = entry + 8 if size <= 4 else struct.unpack_from(end + "I", data, entry + 8)[0]
            if not size or start + size > len(data):
                continue
            if tag in DEEPER and kind == 4:
                todo.append(struct.unpack_from(end + "I", data, start)[0])
            elif tag in TAGS:
                out.setdefault(TAGS[tag], _text(data[start : start + size], kind, count, end, TAGS[tag]))
    return out


def _text(raw: bytes, kind: int, count: int, end: str, name: str) -> str:
    if kind in (2, 7):
        text = raw.split(b"\0")[0].decode("utf-8", "replace").strip()
        # Days are parted by colons there, as nowhere else.
        return text[:10].replace(":", "-") + text[10:] if name.startswith("DateTime") else text
    if kind in (5, 10):
        pairs = struct.unpack(f"{end}{2 * count}{'I' if kind == 5 else 'i'}", raw)
        return ", ".join(f"{a / b:g}" if b else f"{a}/0" for a, b in zip(pairs[::2], pairs[1::2], strict=True))
    return ", ".join(map(str, struct.unpack(f"{end}{count}{NUMBERS[kind]}", raw)))


def with_exif(inventory: DataFrame, content: DataFrame) -> DataFrame:
    """The inventory with ``exif``, from the first bytes of content (path, content); a map without entries where there is none."""
    schema = "path string, exif map<string,string>"

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"path": part["path"], "exif": [read_exif(x) for x in part["head"]]})

    found = content.select("path", F.substring("content", 1, HEAD).alias("head")).mapInPandas(read, schema)
    return inventory.drop("exif").join(found, "path", "left")


def tag(name: str) -> Column:
    """One value of ``exif``; null without it."""
    return F.element_at(F.col("exif"), name)
