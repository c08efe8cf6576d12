"""Quality rules with adaptive cutoffs from mergeable quantile sketches per language and source.

Each text gives counts; their ratios go into log-bucket sketches (relative error ALPHA) that are plain (group, bucket,
count) rows, so they merge by adding counts: over partitions, and from (language, source) up to the language and to
the whole corpus where a group has fewer than MIN_DOCS documents. The cutoffs are outer fences, quartiles plus or
minus REACH times their distance plus a slack, so a clean group rejects nothing. Cutoffs are joined to the documents.

Null text has no words and fails the base rule. Null language or source form groups of their own. Copies count as often
as they occur. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, map_arrow, small_or_shuffled

ALPHA, MIN_DOCS, REACH = 0.01, 100, 3.0
GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: Ratio: (numerator, denominator, has a lower fence, slack).
RATIOS = {
    "word_length": ("word_chars", "n_words", True, 1.0),
    "symbol_share": ("n_symbols", "n_words", False, 0.1),
    "upper_share": ("n_upper", "word_chars", False, 0.1),
    "dup_line_share": ("n_dup_lines", "n_lines", False, 0.4),
    "repeat_share": ("n_repeat_words", "n_words", False, 0.2),
}
COUNTS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_lines long"
_SPACE, _SYMBOLS, _UPPER = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91))


def count_text(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_lines (lines with a word) of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    covered = 0
    if len(set(windows)) < len(windows):
        seen, reach = Counter(windows), 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                covered += i + 3 - max(i, reach)
                reach = i + 3
    gone = lambda chars: len(raw) - len(raw.translate(None, chars))
    return n, len(text) - gone(_SPACE), gone(_SYMBOLS), len(lines) - len(set(lines)), covered, gone(_UPPER), len(lines)


def measure(docs: DataFrame) -> DataFrame:
    """The counts of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [count_text(t) for t in b.column(3).to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)] if counts else [pa.array([], pa.int64())] * 7
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), b.column(2), *columns], names=[c.split()[0] for c in COUNTS.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "lang", "source", "text"), work, COUNTS)


def ratio(name: str) -> Column:
    top, bottom = RATIOS[name][:2]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def bucket(x: Column) -> Column:
    """Log bucket of x; null holds values of 0."""
    return F.when(x > 0, F.ceil(F.log(x) / F.lit(math.log(GAMMA))).cast("int"))


def sketches(counts: DataFrame) -> DataFrame:
    """Mergeable sketches (lang, source, metric, bucket, n), added up before they are shuffled."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(ratio(m)).alias("bucket")) for m in RATIOS])
    return counts.select("lang", "source", F.explode(pairs).alias("p")).groupBy("lang", "source", "p.metric", "p.bucket").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """Low and high cutoff of each (lang, source, metric); sparse groups take those of their language or of all."""
    levels = []
    for keys in (["lang", "source"], ["lang"], []):
        merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
        part = Window.partitionBy(*keys, "metric")
        order = part.orderBy(F.col("bucket").asc_nulls_first())
        at = merged.select(*keys, "metric", "bucket", F.sum("n").over(order).alias("upto"), F.sum("n").over(part).alias("docs"))
        value = F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(F.lit(2.0 / (GAMMA + 1)) * F.pow(F.lit(GAMMA), F.col("bucket")))
        q = lambda p: F.min(F.when(F.col("upto") >= F.col("docs") * p, value))
        levels.append(at.groupBy(*keys, "metric").agg(F.max("docs").alias("docs"), q(0.25).alias("q1"), q(0.75).alias("q3")))
    own, lang, every = (x.select(*[c for c in x.columns if c in ("lang", "source", "metric")], F.struct("docs", "q1", "q3").alias(n)) for x, n in zip(levels, ("own", "of_lang", "of_all"), strict=True))
    full = own.join(lang.withColumnRenamed("lang", "l").withColumnRenamed("metric", "m"), F.col("lang").eqNullSafe(F.col("l")) & (F.col("metric") == F.col("m"))).drop("l", "m").join(every, "metric")
    used = F.when(F.col("own.docs") >= MIN_DOCS, F.col("own")).when(F.col("of_lang.docs") >= MIN_DOCS, F.col("of_lang")).otherwise(F.col("of_all"))
    slack = F.coalesce(*[F.when(F.col("metric") == m, F.lit(r[3])) for m, r in RATIOS.items()])
    low = F.col("metric").isin([m for m, r in RATIOS.items() if r[2]])
    width = (F.col("u.q3") - F.col("u.q1")) * REACH + slack
    return full.withColumn("u", used).select("lang", "source", "metric", F.when(low, F.col("u.q1") - width).alias("low"), (F.col("u.q3") + width).alias("high"))


def judged(docs: DataFrame) -> DataFrame:
    """Counts, base rule and verdict of every document."""
    counts = checkpointed(measure(docs))
    cut = fences(sketches(counts)).groupBy("lang", "source").pivot("metric", list(RATIOS)).agg(F.first("low").alias("low"), F.first("high").alias("high"))
    cut = checkpointed(cut.withColumnRenamed("lang", "l").withColumnRenamed("source", "s"))
    joined = counts.join(small_or_shuffled(cut), F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.lit(True)
    for m, (_, _, low, _) in RATIOS.items():
        inside = inside & (ratio(m) <= F.col(f"{m}_high"))
        if low:
            inside = inside & (ratio(m) >= F.col(f"{m}_low"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(True))).alias("kept"))


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    kept = judged(docs).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["_kept"], "left_semi")


WORDS = "'[^\\x20\\x09-\\x0D]+'"
ORACLE = f"""
WITH base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base)),
covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM windows CROSS JOIN (VALUES (0), (1), (2)) AS x(o) WHERE n > 1 GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM base) WHERE regexp_matches(line, {WORDS}) GROUP BY doc_id),
counts AS (
  SELECT b.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper, coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM base b LEFT JOIN lines l ON l.doc_id = b.doc_id LEFT JOIN covered c ON c.doc_id = b.doc_id),
long AS (
  {" UNION ALL ".join(f"SELECT doc_id, lang, source, '{m}' AS metric, CASE WHEN {d} > 0 THEN {n} / {d} ELSE 0.0 END::DOUBLE AS x FROM counts" for m, (n, d, _, _) in RATIOS.items())}),
bucketed AS (SELECT *, CASE WHEN x > 0 THEN ceil(ln(x) / {math.log(GAMMA)!r})::INT END AS b FROM long),
levels AS (
  SELECT 1 AS level, lang, source, metric, b FROM bucketed
  UNION ALL SELECT 2, lang, NULL, metric, b FROM bucketed UNION ALL SELECT 3, NULL, NULL, metric, b FROM bucketed),
sketch AS (SELECT level, lang, source, metric, b, count(*) AS n FROM levels GROUP BY ALL),
upto AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY b NULLS FIRST) AS upto,
    sum(n) OVER (PARTITION BY level, lang, source, metric) AS docs, CASE WHEN b IS NULL THEN 0 ELSE {2 / (GAMMA + 1)!r} * pow({GAMMA!r}, b) END AS v FROM sketch),
q AS (
  SELECT level, lang, source, metric, max(docs) AS docs, min(v) FILTER (upto >= docs * 0.25) AS q1, min(v) FILTER (upto >= docs * 0.75) AS q3
  FROM upto GROUP BY ALL),
used AS (
  SELECT a.lang, a.source, a.metric, CASE WHEN a.docs >= {MIN_DOCS} THEN a.q1 WHEN b.docs >= {MIN_DOCS} THEN b.q1 ELSE c.q1 END AS q1,
    CASE WHEN a.docs >= {MIN_DOCS} THEN a.q3 WHEN b.docs >= {MIN_DOCS} THEN b.q3 ELSE c.q3 END AS q3
  FROM q a JOIN q b ON b.level = 2 AND b.metric = a.metric AND b.lang IS NOT DISTINCT FROM a.lang JOIN q c ON c.level = 3 AND c.metric = a.metric WHERE a.level = 1),
setup(metric, low, slack) AS (VALUES {", ".join(f"('{m}', {str(low).lower()}, {slack})" for m, (_, _, low, slack) in RATIOS.items())}),
fence AS (
  SELECT lang, source, metric, CASE WHEN low THEN q1 - ((q3 - q1) * {REACH} + slack) END AS low, q3 + ((q3 - q1) * {REACH} + slack) AS high
  FROM used JOIN setup USING (metric)),
inside AS (
  SELECT doc_id, bool_and(x <= high AND (low IS NULL OR x >= low)) AS ok
  FROM long l JOIN fence f ON f.metric = l.metric AND f.lang IS NOT DISTINCT FROM l.lang AND f.source IS NOT DISTINCT FROM l.source GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND ok AS kept
FROM counts JOIN inside USING (doc_id)
"""
