"""The engine's front: load, edit, convert, export and validate any number of recordings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mappers
from ..model import Activities
from ..operators import aggregates, sets
from ..operators import normalize as repair
from ..operators import validate as rules
from ..sources import files
from ..sources.files import EncoderOptions
from .checkpoints import settled

FORMATS = ("gpx", "tcx", "fit", "csv", "geojson")


@dataclass(frozen=True)
class ExportRequest:
    """SNK-16: where recordings come from (a path, or tables), and what becomes of them."""

    to: str
    path: str | None = None
    activities: Activities | None = None
    options: EncoderOptions = EncoderOptions()
    normalize: bool = True
    auto_fix: repair.AutoFix | None = None
    validate: bool = True
    gap_us: int = rules.GAP_US
    label: str | None = None


@dataclass(frozen=True)
class ExportResult:
    """SNK-18: encoded (activity_id, format, content, error), the recordings as exported, findings and counts."""

    encoded: DataFrame
    activities: Activities
    diagnostics: DataFrame
    stats: DataFrame | None = None
    findings: DataFrame | None = field(default=None)

    def texts(self) -> DataFrame:
        """Contents as text; FIT as base64."""
        text = F.when(F.col("format") == "fit", F.base64("content")).otherwise(F.decode("content", "UTF-8"))
        return self.encoded.select("activity_id", "format", text.alias("text"), "error")


class Engine:
    """Operations over a Spark session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def load(self, path, **how) -> Activities:
        """SRC-27, SRC-28: the files under a path; see sources.files.load."""
        return files.load(self.spark, path, **how)

    def load_batch(self, paths: list[str], on_progress=None, stop_on_error: bool = False, files_per_job: int = 1000, **how) -> Activities:
        """SRC-28, UDF-4: many paths, so many files a job; on_progress(done, total) is called after each job.

        With stop_on_error the first job with a finding of severity error is the last.
        """
        out: Activities | None = None
        for i in range(0, len(paths), files_per_job):
            part = self.load(paths[i : i + files_per_job], **how)
            tables = part.tables()
            out = part if out is None else out.having(**{t: getattr(out, t).unionByName(df) for t, df in tables.items()})
            if on_progress is not None:
                on_progress(min(i + files_per_job, len(paths)), len(paths))
            if stop_on_error and part.diagnostics.where("severity = 'error'").limit(1).count():
                break
        if out is None:
            raise ValueError("no paths")
        return out

    def from_tuples(self, location: DataFrame, channels: DataFrame, **more) -> Activities:
        """SRC-29: recordings from location and channel tuples."""
        return files.from_tuples(location, channels, **more)

    def with_sports(self, a: Activities, label: str = "name") -> Activities:
        """FN-2, UDF-1: sports from a label, registered mappers first, where there is none."""
        known = F.when(F.col("sport") != "unknown", F.col("sport"))
        return a.having(info=a.info.withColumn("sport", F.coalesce(known, mappers.sport_column(F.col(label)), F.col("sport"))))

    def export(self, a: Activities, to: str, options: EncoderOptions = EncoderOptions(), **request) -> ExportResult:
        return self.run(ExportRequest(to, activities=a, options=options, **request))

    def convert(self, path, to: str, options: EncoderOptions = EncoderOptions(), **request) -> ExportResult:
        return self.run(ExportRequest(to, path=path, options=options, **request))

    def run(self, request: ExportRequest) -> ExportResult:
        """The pipeline: load, repair, normalize, report losses, encode, validate."""
        if (request.path is None) == (request.activities is None):
            raise ValueError("give either a path or activities")
        a = self.load(request.path) if request.activities is None else request.activities
        if request.label is not None:
            a = self.with_sports(a, request.label)
        full = a.having(samples=a.table("samples", self.spark), points=a.table("points", self.spark))
        done, notes = full, [] if a.diagnostics is None else [a.diagnostics.select("activity_id", "severity", "code", "message")]
        if request.auto_fix is not None:
            done = settled(repair.auto_fix(full, request.auto_fix))
            fixed = repair.auto_fix_diagnostics(full, done)
            notes.append(fixed.select("activity_id", "severity", "code", F.col("n").cast("string").alias("message")))
        stats = None
        if request.normalize:
            before, done = done, settled(repair.normalize(done))
            stats = aggregates.normalization_stats(before, done)
            from ..operators.edit import repair_diagnostics

            repaired = repair_diagnostics(before)
            notes.append(repaired.select("activity_id", "severity", "code", F.col("n").cast("string").alias("message")))
        notes.append(lossy_report(done, request.to))
        findings = rules.validate(done, request.gap_us) if request.validate else None
        if findings is not None:
            notes.append(rules.flattened(findings).select(F.col("activity_id").cast("string"), "severity", "code", F.col("detail").alias("message")))
        every = notes[0].withColumn("activity_id", F.col("activity_id").cast("string"))
        for n in notes[1:]:
            every = every.unionByName(n.withColumn("activity_id", F.col("activity_id").cast("string")))
        return ExportResult(files.encoded(done, request.to, request.options), done, every, stats, findings)

    def merge(self, a: Activities, into, order, **how) -> Activities:
        return sets.merge(a, into, order, **how)

    def split_by_sport(self, a: Activities, **how) -> Activities:
        return sets.split_by_sport(a, **how)

    def validate(self, a: Activities, gap_us: int = rules.GAP_US) -> DataFrame:
        return rules.validate(a, gap_us)

    def save(self, a: Activities, folder: str) -> None:
        """All tables as Parquet, points and samples clustered by recording for later scans."""
        for t, df in a.tables().items():
            sorted_by = [c for c in (*a.keys, "channel", "seq") if c in df.columns]
            df.sortWithinPartitions(*sorted_by).write.mode("overwrite").parquet(f"{folder}/{t}")

    def open(self, folder: str, tables=("info", "points", "samples", "laps")) -> Activities:
        return Activities(**{t: self.spark.read.parquet(f"{folder}/{t}") for t in tables})


def lossy_report(a: Activities, to: str) -> DataFrame:
    """SNK-17: what a format cannot hold of each recording, with the number of rows that go."""
    key, parts = a.keys[0], []

    def dropped(table: DataFrame | None, code: str, where=None) -> None:
        if table is not None:
            rows = table if where is None else table.where(where)
            parts.append(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(key, F.lit(f"lossy.{code}").alias("code"), "n"))

    if to != "gpx" and a.points is not None and "track_no" in a.points.columns:
        tracks = a.points.groupBy(key).agg((F.countDistinct("track_no") - 1).alias("n")).where("n > 0")
        parts.append(tracks.select(key, F.lit("lossy.multi_track_flattened").alias("code"), "n"))
    if to != "fit":
        dropped(a.sets, "sets_dropped")
        dropped(a.events, "events_dropped")
        dropped(a.lengths, "lengths_dropped")
        if a.info is not None and "summary" in a.info.columns:
            later = F.exists(F.map_keys("summary"), lambda k: k.startswith("session"))
            dropped(a.info, "sessions_dropped", F.col("summary").isNotNull() & later)
            dropped(a.info, "summary_dropped", F.size("summary") > 0)
    if to in ("gpx", "csv"):
        dropped(a.laps, "laps_dropped")
    if not parts:
        parts.append(a.points.select(key, F.lit("").alias("code"), F.lit(0).cast("long").alias("n")).where(F.lit(False)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col(key).cast("string").alias("activity_id"), F.lit("info").alias("severity"), "code", F.col("n").cast("string").alias("message"))
