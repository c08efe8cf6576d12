"""Column expressions of the activity operators: time, geometry, interpolation, text and sport labels."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
#: Sports, and the keywords that name them in order of precedence (fixed values).
SPORTS = ("running", "cycling", "swimming", "walking", "hiking", "other", "unknown")
SPORT_KEYWORDS = (
    ("running", ("run", "running", "jog", "jogging")),
    ("cycling", ("cycle", "cycling", "bike", "biking", "ride")),
    ("swimming", ("swim", "swimming")),
    ("walking", ("walk", "walking")),
    ("hiking", ("hike", "hiking")),
    ("other", ("other",)),
)
SPORT_NUMBERS = ("other", "running", "cycling", "swimming", "walking", "hiking")
#: Labels of exercise categories by number (fixed values).
EXERCISES = (
    "Bench Press", "Calf Raise", "Cardio", "Carry", "Chop", "Core", "Crunch", "Curl", "Deadlift", "Fly", "Hip Raise", "Hip Stability",
    "Hip Swing", "Hyperextension", "Lateral Raise", "Leg Curl", "Leg Raise", "Lunge", "Olympic Lift", "Plank", "Plyometric", "Pull-up", "Push-up",
    "Row", "Shoulder Press", "Shoulder Stability", "Shrug", "Sit-up", "Squat", "Total Body", "Triceps Extension", "Warm-up", "Run",
)


def micros(value) -> Column:
    """Microseconds since 1970 UTC of a datetime, a timedelta, a number or a column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, timedelta):
        return F.lit(value // timedelta(microseconds=1))
    if isinstance(value, datetime):
        value = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        return F.lit((value - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1))
    return F.lit(int(value)).cast("long")


def span(value) -> int:
    """A duration as whole microseconds; numbers are microseconds already."""
    return value // timedelta(microseconds=1) if isinstance(value, timedelta) else int(value)


def micros_of_ntz(ts: Column) -> Column:
    """Microseconds of a timestamp without zone, read as UTC whatever the session's zone is."""
    day = F.unix_date(F.to_date(ts)).cast("long") * 86_400_000_000
    clock = F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000
    return day + clock + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def iso8601(us: Column) -> Column:
    """UTC text of microseconds with three decimals, or six where needed."""
    seconds = F.floor(us / 1_000_000).cast("long")
    rest = F.pmod(us, F.lit(1_000_000))
    base = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_seconds(seconds).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(F.pmod(rest, F.lit(1000)) == 0, F.lpad((rest / 1000).cast("long").cast("string"), 3, "0")).otherwise(F.lpad(rest.cast("string"), 6, "0"))
    return F.concat(base, F.lit("."), fraction, F.lit("Z"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres, arctangent form."""
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def lerp(a: Column, b: Column, factor: Column) -> Column:
    return a + (b - a) * factor


def time_factor(t0: Column, t1: Column, t: Column) -> Column:
    """Where t lies between t0 and t1; 0 where they are equal."""
    return F.when(t1 == t0, F.lit(0.0)).otherwise((t - t0) / (t1 - t0))


def channel_id(c: Column) -> Column:
    return F.lower(F.trim(c))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def valid_latitude(c: Column) -> Column:
    return finite(c) & c.between(-90, 90)


def valid_longitude(c: Column) -> Column:
    return finite(c) & c.between(-180, 180)


def infer_sport(label: Column) -> Column:
    """Sport named by a label: numbers 0 to 5 by table when the text is a number, else the first keyword that is a token."""
    tokens = F.split(F.lower(F.trim(label)), "[^a-z0-9]+")
    out = F.lit(None).cast("string")
    for sport, words in reversed(SPORT_KEYWORDS):
        out = F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, words))), F.lit(sport)).otherwise(out)
    return out


def sport_of_number(n: Column) -> Column:
    """Sport of a small number; others are null."""
    return F.get(F.array(*map(F.lit, SPORT_NUMBERS)), n.cast("int"))


def exercise_label(category: Column) -> Column:
    """Label of an exercise category, null outside the table."""
    return F.get(F.array(*map(F.lit, EXERCISES)), category.cast("int"))


def file_extension(name: Column) -> Column:
    """Lower-case extension of a path without its query, or null."""
    return blank_to_null(F.lower(F.regexp_extract(F.regexp_replace(name, "[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1)))


def developer_channel(name: Column) -> Column:
    """Channel id of a developer field: letters, digits and single underscores; null if empty or begun by a digit."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when((clean != "") & ~clean.rlike("^[0-9]"), clean)


def version_text(major: Column, minor: Column, build_major: Column | None = None, build_minor: Column | None = None) -> Column:
    """major.minor, with +bmajor.minor where the build is there."""
    base = F.concat_ws(".", major.cast("string"), minor.cast("string"))
    if build_major is None:
        return base
    return F.concat(base, F.coalesce(F.concat(F.lit("+b"), build_major.cast("string"), F.lit("."), build_minor.cast("string")), F.lit("")))


def fixed_text(x: Column, digits: int) -> Column:
    """A number with exactly so many decimals."""
    return F.format_string(f"%.{digits}f", x.cast("double"))


def csv_field(c: Column) -> Column:
    """A field in quotes if it holds a comma, a quote or a line break."""
    text = c.cast("string")
    return F.when(text.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(text, F.lit("")))


def semicircles(degrees: Column) -> Column:
    return F.round(degrees * (2.0**31 / 180.0)).cast("int")


def node_path(path: Column, index: Column, description: Column) -> Column:
    """path[index] (description), without the parts that are null."""
    return F.concat(path, F.coalesce(F.concat(F.lit("["), index.cast("string"), F.lit("]")), F.lit("")), F.coalesce(F.concat(F.lit(" ("), description, F.lit(")")), F.lit("")))
