"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A text is the set of its 64-bit hashed five-word shingles. Sketching throws the whole set into t bins, round after round
with fresh hashes, and keeps the least value of each bin. From round t on each round fills one bin for certain, so every
coordinate is filled; for large sets one round does. Estimates concentrate like those of t independent hashes at a cost
near the set's size. Bands of coordinates find candidates: a pair at the bound is missed with probability below 1e-6.

Links are confirmed on the full sets. Groups need connectivity only, so a hot bucket never yields all its pairs: equal
sets are one node, each bucket links its members to a hub, and joined groups count as one from then on. What is left
between groups is checked exhaustively: pair by pair in small buckets, and for large ones, merged where they overlap,
block against block inside tasks of bounded size, which give only links that join two groups. A pair in a block is
compared in full unless its sketches already exclude the similarity. Groups are found by star contraction on DataFrames.

Null text, empty text and texts without a word are empty sets, linked with nothing; rows without doc_id likewise. Texts with fewer than five words
are one shingle. Rows that repeat a doc_id count as one document with the links of all its texts. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.plans.shipping import shipped

from .common import checkpointed, joined_by_count, map_arrow, numbered, small_or_shuffled, spread, working_tables

WORDS = 5
#: Ids of candidates up to which they are broadcast (8 bytes each) to filter the texts; more are joined by shuffle.
CANDIDATES_BROADCAST = 500_000
#: Hub rounds stop when this many pairs per node are left in all buckets, or after HUB_ROUNDS.
PAIRS_PER_NODE, HUB_ROUNDS = 1, 2
#: Buckets above this size are finished in blocks of so many nodes, without making pairs.
SMALL_BUCKET, BLOCK = 24, 256
#: Pairs of one text that go to one task; the pairs of a text with more are dealt in chunks, and its text is sent once to each.
CHUNK = 256
Keep = Callable[[DataFrame], DataFrame]
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Scheme:
    """Pairs with 100 * intersection >= percent * union are linked; bands of so many rows of the sketch find them.

    A pair at the bound is missed with probability (1 - (percent / 100) ** rows) ** bands.
    """

    percent: int
    bands: int
    rows: int

    @property
    def size(self) -> int:
        """Coordinates of a sketch."""
        return self.bands * self.rows

    @property
    def least_equal(self) -> int:
        """Agreeing coordinates that a pair at the bound has but for a chance below 1e-7 (5.5 standard deviations)."""
        p = self.percent / 100
        return int(self.size * (p - 5.5 * (p * (1 - p) / self.size) ** 0.5))


#: Similarity 0.85, missed with probability 2.4e-7, and 0.8, missed with probability 4.6e-7.
STRICT, WIDE = Scheme(85, 48, 8), Scheme(80, 48, 6)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * _P2
    x = (x ^ (x >> np.uint64(27))) * _P3
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    from xxhash import xxh3_64_intdigest as h

    cut = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = np.array([len(c) for c in cut], np.int64)
    flat = np.fromiter((h(w) for c in cut for w in c), np.uint64, int(sizes.sum()))
    out, at = [], 0
    with np.errstate(over="ignore"):
        count = max(len(flat) - words + 1, 0)
        rolled = np.zeros(count, np.uint64)
        for i in range(words):
            rolled = mix(rolled * _P1 + flat[i : i + count])
        for n in sizes.tolist():
            if n >= words:
                out.append(np.unique(rolled[at : at + n - words + 1]))
            elif n:
                x = np.zeros(1, np.uint64)
                for v in flat[at : at + n]:
                    x = mix(x * _P1 + v)
                out.append(mix(x + np.uint64(n)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out


def sketch(sets: list[np.ndarray], t: int = STRICT.size) -> np.ndarray:
    """(sets, t) sketches; empty sets give zeros."""
    out = np.zeros((len(sets), t), np.uint64)
    live = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(live):
        return out
    sizes = np.array([len(sets[i]) for i in live])
    items, owner = np.concatenate([sets[i] for i in live]), np.repeat(live, sizes)
    flat, filled = out.reshape(-1), np.zeros(len(sets) * t, bool)
    with np.errstate(over="ignore"):
        for r in range(2 * t):
            v = mix(items + _P1 * np.uint64(r + 1))
            bins = owner * t + ((v % np.uint64(t)).astype(np.int64) if r < t else r - t)
            free = ~filled[bins]
            where, v = bins[free], (v[free] >> np.uint64(1)) + np.uint64(r)
            if len(where):
                order = np.lexsort((v, where))
                where, v = where[order], v[order]
                first = np.ones(len(where), bool)
                first[1:] = where[1:] != where[:-1]
                flat[where[first]], filled[where[first]] = mix(v[first] + np.uint64(r)), True
            short = ~filled.reshape(len(sets), t).all(1)
            keep = short[owner]
            items, owner = items[keep], owner[keep]
            if not len(items):
                break
    return out


def bands(sketches: np.ndarray, scheme: Scheme) -> np.ndarray:
    """(sets, bands) hashes of the bands, as signed numbers."""
    parts = sketches.reshape(len(sketches), scheme.bands, scheme.rows)
    with np.errstate(over="ignore"):
        key = np.arange(scheme.bands, dtype=np.uint64)[None, :] * _P1
        for i in range(scheme.rows):
            key = mix(key * _P3 + parts[:, :, i])
    return key.view(np.int64)


def sketched(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, bands): set size, a 128-bit digest of the set, and the band keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        for b in batches:
            sets = shingles(b.column(1).to_pylist())
            digests = [xxh3_128_intdigest(s.tobytes()) for s in sets]
            keys = bands(sketch(sets, scheme.size), scheme)
            low = (1 << 64) - 1
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array([d >> 64 for d in digests], np.uint64).view(np.int64)), pa.array(np.array([d & low for d in digests], np.uint64).view(np.int64)),
                pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), scheme.bands).cast(pa.list_(pa.int64())),
            ], names=["doc_id", "n_shingles", "h1", "h2", "bands"])

    return map_arrow(spread(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id"), work, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct arrays."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(_doc, text) of the documents in ids (_id, materialized), once each; the ids are broadcast while they are few, so that only their texts move."""
    few = small_or_shuffled(ids, CANDIDATES_BROADCAST)
    return docs.select(F.col("doc_id").cast("long").alias("_doc"), "text").join(few, F.col("_doc") == F.col("_id"), "left_semi")


def verified(pairs: DataFrame, docs: DataFrame, percent: int, keep: Keep) -> DataFrame:
    """The pairs (a, b; materialized) and whether their full sets are similar enough, once for each text of either.

    Each pair goes to the end with more pairs, in chunks of some CHUNK, so a hub's text moves once for each chunk and no
    task has all pairs of a hub. The text of the other end moves once for each of its pairs; as it has no more pairs
    than the hub, that is at most the square root of the number of all pairs.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            texts = [*dict.fromkeys([*a, *b])]
            sets = dict(zip(texts, shingles(texts), strict=True))
            fine = [similar(sets[x], sets[y], percent) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fine, pa.bool_())], names=["a", "b", "linked"])

    ends = keep(pairs.select(F.explode(F.array("a", "b")).alias("_id")).groupBy("_id").agg(F.count(F.lit(1)).alias("_pairs")))
    some = texts_of(docs, ends.select("_id"))
    hot = ends.where(F.col("_pairs") > CHUNK).select("_id", F.ceil(F.col("_pairs") / CHUNK).cast("int").alias("_chunks"))
    of = lambda k: hot.select(F.col("_id").alias(k), F.col("_chunks").alias(f"_{k}"))
    turned = F.coalesce("_b", F.lit(1)) > F.coalesce("_a", F.lit(1))
    hub, other = F.when(turned, F.col("b")).otherwise(F.col("a")), F.when(turned, F.col("a")).otherwise(F.col("b"))
    chunk = F.pmod(F.xxhash64(other), F.greatest(F.coalesce("_a", F.lit(1)), F.coalesce("_b", F.lit(1)))).cast("int")
    dealt = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select(hub.alias("hub"), other.alias("other"), chunk.alias("chunk"))
    hubs = some.join(hot, F.col("_doc") == F.col("_id"), "left").select(F.col("_doc").alias("hub"), F.explode(F.sequence(F.lit(0), F.coalesce("_chunks", F.lit(1)) - 1)).alias("chunk"), F.col("text").alias("hub_text"))
    joined = dealt.join(some.withColumnRenamed("_doc", "other"), "other").join(hubs, ["hub", "chunk"])
    return map_arrow(joined.select(F.least("hub", "other").alias("a"), F.greatest("hub", "other").alias("b"), "text", "hub_text"), work, "a long, b long, linked boolean")


def block_links(members: DataFrame, docs: DataFrame, scheme: Scheme, keep: Keep) -> DataFrame | None:
    """Links (a, b) that join different roots among the members (key, node, root; materialized) of large buckets; None without members.

    Buckets that share nodes are one cluster. The nodes of its largest root need no comparison among themselves, so only
    pairs of blocks of which one holds nodes of other roots are tasks: texts move in proportion to the nodes times the
    blocks of the minority.
    """
    if members.isEmpty():
        return None
    star = members.groupBy("key").agg(F.min("node").alias("b"))
    clusters = components(members.join(star, "key").select(F.col("node").alias("a"), "b"), keep)
    nodes = keep(relabelled(members.select("node", "root").distinct(), clusters, "node", "cluster"))
    largest = nodes.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.min(F.struct(-F.col("n"), "root"))["root"].alias("top"))
    sided = keep(nodes.join(largest, "cluster").withColumn("major", F.col("root") == F.col("top")).drop("top"))
    placed = keep(numbered(sided, ["cluster", "major"], ["node"], "place").withColumn("block", F.floor(F.col("place") / BLOCK).cast("int")))
    last = lambda major: F.max(F.when(F.col("major") == major, F.col("block")))
    counted = placed.groupBy("cluster").agg((last(False) + 1).alias("minor"), (last(True) + 1).alias("all")).where("minor > 0")
    some = texts_of(docs, placed.select(F.col("node").alias("_id"))).withColumnRenamed("_doc", "node")
    full = placed.join(counted, "cluster").join(some, "node").dropDuplicates(["node", "text"])
    full = full.withColumn("block", F.when(F.col("major"), F.col("block") + F.col("minor")).otherwise(F.col("block")))
    ends = F.when(F.col("major"), F.col("minor")).otherwise(F.col("minor") + F.col("all")) - 1
    dealt = full.withColumn("other", F.explode(F.sequence(F.lit(0), ends)))
    dealt = dealt.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root", "text")

    least, percent = scheme.least_equal, scheme.percent

    def work(table: pa.Table) -> pa.Table:
        block, node = np.array(table.column("block")), np.array(table.column("node"))
        one, two = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        order = np.lexsort((node, block))
        sets = shingles([table.column("text")[int(k)].as_py() for k in order])
        node, root, block = node[order], np.array(table.column("root"))[order], block[order]
        marks = (sketch(sets, scheme.size) & np.uint64(0xFFFF)).astype(np.uint16)
        sizes, out = np.array([len(s) for s in sets]), []
        ends = len(node) if one == two else int((block == one).sum())
        for k in range(ends):
            first = k + 1 if one == two else ends
            near = (marks[first:] == marks[k]).sum(1) >= least
            near &= (100 * np.minimum(sizes[first:], sizes[k]) >= percent * np.maximum(sizes[first:], sizes[k])) & (root[first:] != root[k])
            for m in np.flatnonzero(near) + first:
                if root[m] != root[k] and similar(sets[k], sets[m], percent):
                    root[root == root[m]] = root[k]
                    out.append((min(node[k], node[m]), max(node[k], node[m])))
        return pa.table({"a": pa.array([int(x) for x, _ in out], pa.int64()), "b": pa.array([int(y) for _, y in out], pa.int64())})

    return keep(dealt.groupBy("cluster", "i", "j").applyInArrow(shipped(work), "a long, b long"))


def is_star_forest(edges: DataFrame) -> bool:
    """Whether each node a has one edge (a, b) and no b has an edge of its own."""
    end = lambda v, out: F.struct(F.col(v).alias("v"), F.lit(out).alias("out"), F.lit(1 - out).alias("into"))
    ends = edges.select(F.explode(F.array(end("a", 1), end("b", 0))).alias("e")).select("e.*")
    degrees = ends.groupBy("v").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not degrees.agg(F.max(F.col("out") + F.when(F.col("out") > 0, F.col("into")).otherwise(0)) > 1).first()[0]


def components(edges: DataFrame, keep: Keep = checkpointed) -> DataFrame:
    """(node, root): the least node reachable, for the nodes of edges (a, b); alternating large-star and small-star steps.

    Both steps deal the edges by one end only, each result is kept before it is used twice, and edges lead from larger
    to smaller nodes, so when each component is a star its root is the least node.
    """
    edges = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not is_star_forest(edges):
        ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        both = edges.select(F.explode(ways).alias("e")).select("e.a", "e.b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = keep(both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = keep(small.distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def relabelled(rows: DataFrame, roots: DataFrame, node: str, out: str) -> DataFrame:
    """rows with out = the root of node, or node itself."""
    r = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return rows.join(r, rows[node] == r["_n"], "left").withColumn(out, F.coalesce("_r", node)).drop("_n", "_r")


def grouped(docs: DataFrame, scheme: Scheme = STRICT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    with working_tables(docs.sparkSession) as keep:
        return checkpointed(_grouped(docs, scheme, keep)).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _grouped(docs: DataFrame, scheme: Scheme, keep: Keep) -> DataFrame:
    sets = keep(sketched(docs, scheme))
    alike = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = keep(alike.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    same = joined_by_count(alike.select("doc_id", "h1", "h2"), nodes, ["h1", "h2"], "doc_id")
    copies = keep(same.where("doc_id <> node").select("doc_id", "node", "h1", "h2").distinct())
    own = ["doc_id", "h1", "h2"]
    lone = keep(alike.select(*own, "bands").join(copies.select(*own), own, "left_anti").dropDuplicates(own))
    copied = copies.groupBy("doc_id").agg(F.min("node").alias("node"))
    # A document with several texts joins the groups of all of them. Most corpora have none, so their empty join is not run.
    several = keep(alike.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("x"), F.max(F.struct("h1", "h2")).alias("y")).where("x <> y").select("doc_id"))
    links = None
    if not several.isEmpty():
        links = keep(copies.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    keyed = lone.select(F.col("doc_id").alias("node"), F.explode("bands").alias("key"))
    crowded = keep(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    buckets = keep(joined_by_count(keyed, crowded, ["key"], "node"))
    left = keep(buckets.select(F.col("node").alias("_id")).distinct())
    nodes_left, docs = left.count(), keep(texts_of(docs, left).withColumnRenamed("_doc", "doc_id"))
    checked, roots = None, None if links is None else components(links, keep)
    for hub_round in range(HUB_ROUNDS + 1):
        now = buckets.withColumn("root", F.col("node")) if roots is None else keep(relabelled(buckets, roots, "node", "root"))
        size = now.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("node", F.lit(hub_round)), "node"))["node"].alias("hub"))
        head = size.groupBy("key").agg(F.min(F.struct(-F.col("size"), "root", "hub")).alias("top"), F.sum("size").alias("all"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
        active = keep(head.select("key", F.col("top.root").alias("top"), F.col("top.hub").alias("hub"), "all"))
        rest = active.join(size, "key").agg(F.sum(F.when(F.col("root") != F.col("top"), F.col("size") * F.col("all")))).first()[0] or 0
        if not rest:
            break
        last = rest <= PAIRS_PER_NODE * nodes_left or hub_round == HUB_ROUNDS
        if last:
            small = now.join(active.where(F.col("all") <= SMALL_BUCKET).select("key", "top"), "key")
            x, y = small.where("root <> top").select("key", F.col("node").alias("x"), F.col("root").alias("xr")), small.select("key", F.col("node").alias("y"), F.col("root").alias("yr"))
            pairs = x.join(y, "key").where("xr <> yr")
        else:
            pairs = now.join(active, "key").where("root <> top").select(F.col("node").alias("x"), F.col("hub").alias("y"))
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        found = keep(verified(keep(pairs), docs, scheme.percent, keep))
        checked = found.select("a", "b") if checked is None else checked.unionAll(found.select("a", "b"))
        fresh = found.where("linked").select("a", "b")
        links = fresh if links is None else links.unionAll(fresh)
        if last:
            hot = now.join(active.where(F.col("all") > SMALL_BUCKET).select("key"), "key")
            blocks = block_links(keep(hot), docs, scheme, keep)
            links = links if blocks is None else links.unionAll(blocks)
        roots = components(links, keep)
        if last:
            break
    out = relabelled(sets.select("doc_id", "n_shingles"), copied.select(F.col("doc_id").alias("node"), F.col("node").alias("root")), "doc_id", "_node")
    out = out.withColumn("component_id", F.col("_node")) if roots is None else relabelled(out, roots, "_node", "component_id")
    return out.select("doc_id", "n_shingles", "component_id")


def deduplicated(docs: DataFrame, scheme: Scheme = WIDE) -> DataFrame:
    """One document of each group, with all its columns; rows without doc_id stay."""
    gone = small_or_shuffled(grouped(docs, scheme).where("NOT kept").select(F.col("doc_id").alias("_gone")), CANDIDATES_BROADCAST)
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
