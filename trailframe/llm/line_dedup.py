"""Line deduplication over overlapping three-line windows, in DataFrame operations only.

Every three consecutive lines of a document are hashed (128 bits); a document of one or two lines is one window of all
its lines. Windows without a visible character are not compared. The first occurrence of a window, by (doc_id, line),
stays; the lines that any later occurrence covers are removed, overlapping ones once. A removed line has an equal line
at an earlier place, so each content survives somewhere.

Null text stays null with no lines; an empty text is one empty line. Rows without doc_id stay as they are; rows that
repeat a doc_id are one document. A document whose lines all go keeps its row with an empty text. Other columns pass
through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, joined_by_count


WINDOW = 3
#: Bytes of all removals (their ids and positions) up to which these are broadcast, so that texts need no shuffle.
MOST_BROADCAST = 48 << 20


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, at, a, b): where each window begins and its two hashes, made of the hashes of its lines."""
    line = lambda text: F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"), (F.length(F.translate(text, " \t\r", "")) > 0).alias("seen"))
    some = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.transform(F.split("text", "\n"), line).alias("lines"))
    count = F.greatest(F.size("lines") - (WINDOW - 1), F.lit(1))
    part = lambda i, c: [F.get(F.col("lines"), i + k)[c] for k in range(WINDOW)]
    seen = lambda i: F.coalesce(part(i, "seen")[0], F.lit(False)) | F.coalesce(part(i, "seen")[1], F.lit(False)) | F.coalesce(part(i, "seen")[2], F.lit(False))
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("at"), F.xxhash64(*part(i, "a")).alias("a"), F.xxhash64(*part(i, "b")).alias("b"), seen(i).alias("seen")))
    found = some.select("doc_id", F.explode(cut).alias("w"))
    return found.where("w.seen").select("doc_id", "w.at", "w.a", "w.b")


def removals(docs: DataFrame) -> DataFrame:
    """(_id, _gone): the sorted positions of the lines to remove from each document that has any."""
    found = checkpointed(windows(docs))
    first = checkpointed(found.groupBy("a", "b").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    later = joined_by_count(found, first, ["a", "b"], "doc_id", "at").where(F.struct("doc_id", "at") != F.col("first"))
    covered = later.groupBy("doc_id").agg(F.collect_set("at").alias("ats"))
    spread = F.flatten(F.transform("ats", lambda p: F.sequence(p, p + WINDOW - 1)))
    return covered.select(F.col("doc_id").alias("_id"), F.array_sort(F.array_distinct(spread)).alias("_gone"))


def kept_text(text: Column, gone: Column) -> Column:
    lines = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with the remaining text, and the numbers of lines and of removed lines in _n_lines and _n_removed (with underscores while docs has such a column)."""
    gone = checkpointed(removals(docs))
    weight = gone.agg(F.sum(F.size("_gone") * 4 + 64)).first()[0] or 0
    gone = F.broadcast(gone) if weight <= MOST_BROADCAST else gone.hint("shuffle_hash")
    joined = docs.join(gone, docs["doc_id"] == gone["_id"], "left")
    size = F.when(docs["text"].isNull(), F.lit(0)).otherwise(F.size(F.split(docs["text"], "\n")))
    text = F.when(gone["_gone"].isNull() | docs["text"].isNull(), docs["text"]).otherwise(kept_text(docs["text"], gone["_gone"]))
    removed = F.coalesce(F.size(F.filter(gone["_gone"], lambda i: i < size)), F.lit(0))
    removed = F.when(gone["_gone"].isNull(), F.lit(0)).otherwise(removed)
    return joined.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns], size.cast("long").alias(fresh("_n_lines", docs.columns)), removed.cast("long").alias(fresh("_n_removed", docs.columns)))


ORACLE_CTE = """
numbered AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM {docs}),
spots AS (SELECT doc_id, lines, unnest(range(0, greatest(len(lines) - 2, 1))) AS pos FROM numbered WHERE text IS NOT NULL AND doc_id IS NOT NULL),
pieces AS (SELECT doc_id, pos, array_to_string(lines[pos + 1:pos + 3], chr(10)) AS piece FROM spots),
visible AS (SELECT * FROM pieces WHERE length(translate(piece, ' ' || chr(9) || chr(13) || chr(10), '')) > 0),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY piece ORDER BY doc_id, pos) AS nth FROM visible),
gone AS (SELECT DISTINCT doc_id, pos + o AS line FROM ranked CROSS JOIN (VALUES (0), (1), (2)) AS x(o) WHERE nth > 1),
each_line AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS i FROM numbered),
left_over AS (
  SELECT e.doc_id, count(*) AS n_lines, count(*) FILTER (g.line IS NOT NULL) AS n_removed,
    coalesce(string_agg(e.line, chr(10) ORDER BY e.i) FILTER (g.line IS NULL), '') AS text
  FROM each_line e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.line = e.i GROUP BY e.doc_id)
"""
ORACLE = "WITH " + ORACLE_CTE.format(docs="documents").strip() + " SELECT doc_id, text, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed FROM left_over"
