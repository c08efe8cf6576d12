"""What format a payload has, and texts from bytes with any byte order mark."""

from __future__ import annotations

import base64
import binascii
import codecs
import re

SNIFF_BYTES = 131_072
#: Suffixes and formats (fixed values).
SUFFIXES = {"gpx": "gpx", "tcx": "tcx", "fit": "fit", "csv": "csv", "geojson": "geojson", "json": "geojson"}
MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def detect(data: bytes, name: str | None = None) -> str | None:
    """The format by suffix, else by content; null where neither tells."""
    suffix = re.search(r"\.([A-Za-z0-9]+)$", re.sub(r"[?#].*$", "", name or ""))
    if suffix and suffix[1].lower() in SUFFIXES:
        return SUFFIXES[suffix[1].lower()]
    return sniff(data)


def sniff(data: bytes) -> str | None:
    head = data[:SNIFF_BYTES]
    if head[8:12] == b".FIT":
        return "fit"
    text = decode_text(head)
    low = text.lower().lstrip()
    if low.startswith(("{", "[")) and re.search(r'"type"\s*:\s*"(feature|featurecollection|linestring|point|multilinestring|polygon)"', low):
        return "geojson"
    if "<gpx" in low:
        return "gpx"
    if "trainingcenterdatabase" in low or "<tcx" in low:
        return "tcx"
    header = low.split("\n", 1)[0]
    if "," in header and {"timestamp", "latitude", "longitude"} <= {c.strip(' "\r') for c in header.split(",")}:
        return "csv"
    if looks_base64(text):
        return "fit"
    if not any(data.startswith(m) for m, _ in MARKS) and binary(head):
        return "fit"
    return None


def looks_base64(text: str) -> bool:
    packed = re.sub(r"\s", "", text)
    if len(packed) < 16 or len(packed) % 4 or not re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", packed):
        return False
    try:
        return base64.b64decode(packed[:64])[8:12] == b".FIT"
    except binascii.Error:
        return False


def binary(head: bytes) -> bool:
    """A NUL, or more than four other control bytes."""
    return 0 in head or sum(b < 32 and b not in (9, 10, 12, 13) for b in head[:4096]) > 4


def decode_text(data: bytes, encoding: str = "utf-8") -> str:
    """Text by its byte order mark, else by the given encoding; bad bytes are replaced."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace").replace("\0", "")
    return data.decode(encoding, "replace")
