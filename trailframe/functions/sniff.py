"""Format detection as a column expression, for scans of many files without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import file_extension

SNIFF_BYTES = 131_072
SUFFIXES = {"gpx": "gpx", "tcx": "tcx", "fit": "fit", "csv": "csv", "geojson": "geojson", "json": "geojson"}


def detect_format(name: Column, content: Column) -> Column:
    """SRC-24, FN-19: the format by suffix, else by the first 128 KiB of the content; null where neither tells.

    Bytes are read one to one as characters, and NUL characters of wider encodings are skipped, which is enough for the
    markers looked for.
    """
    head = F.substring(content, 1, SNIFF_BYTES)
    text = F.decode(head, "ISO-8859-1")
    low = F.ltrim(F.lower(F.regexp_replace(text, "[\\x00\\xEF\\xBB\\xBF\\xFE\\xFF]", "")))
    marked = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF") | (F.hex(F.substring(content, 1, 3)) == "EFBBBF")
    header = F.split(F.substring_index(low, "\n", 1), "[,\"\\r ]+")
    is_fit = lambda c: F.hex(F.substring(c, 9, 4)) == "2E464954"
    packed = F.regexp_replace(text, "\\s", "")
    base64 = packed.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length(packed) >= 16) & (F.length(packed) % 4 == 0) & F.coalesce(is_fit(F.try_to_binary(F.substring(packed, 1, 64), F.lit("base64"))), F.lit(False))
    control = F.length(F.regexp_replace(F.substring(text, 1, 4096), "[^\\x01-\\x08\\x0B\\x0E-\\x1F]", "")) > 4
    geojson = low.rlike("^[\\[{]") & low.rlike('"type"\\s*:\\s*"(feature|featurecollection|linestring|point|multilinestring|polygon)"')
    sniffed = (
        F.when(is_fit(content), "fit").when(geojson, "geojson").when(low.contains("<gpx"), "gpx").when(low.contains("trainingcenterdatabase") | low.contains("<tcx"), "tcx")
        .when(F.size(F.array_intersect(header, F.array(F.lit("timestamp"), F.lit("latitude"), F.lit("longitude")))) == 3, "csv")
        .when(base64, "fit").when(~marked & (text.contains("\0") | control), "fit"))
    suffix = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])[file_extension(name)]
    return F.coalesce(suffix, sniffed)
