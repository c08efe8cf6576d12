"""Best-fit packing of token pieces into sequences by patterns fitted with non-negative least squares.

Only the histogram of piece lengths (at most CONTEXT numbers) reaches the driver. Patterns of two or three lengths that
fill a sequence exactly are enumerated, their repeat counts fitted to the histogram by projected gradients, rounded and
held to what is there; what is left is packed best-fit decreasing, still on counts. The plan is a list of intervals
(length, ranks -> sequences, offsets) whose size does not depend on the corpus; pieces get gapless ranks within their
length and look their place up.

Null text counts as empty: one piece with the end id. Copies are packed each; repeated rows likewise. A text of any
length is cut into full pieces, the first of which may be shorter. Other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_arrow, numbered, spread

CONTEXT, END_ID = 2048, 0
#: Patterns tried: as many as pieces / PIECES_PER_PATTERN within these bounds, so that repeat counts are not all fractions.
LEAST_PATTERNS, MOST_PATTERNS, PIECES_PER_PATTERN = 2_000, 40_000, 12
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str):
    """A function from text to uint32 ids, as the tokenizers library gives them for this byte-level BPE file.

    The vocabulary is run by tiktoken, which is faster; texts with the string of a special token go to tokenizers itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(path)

    def ids(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)

    return ids


def cut(ids: np.ndarray, context: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces; only the first may be shorter than context."""
    first = len(ids) % context
    return [(0, first)] * (first > 0) + [(a, a + context) for a in range(first, len(ids), context)]


def tokenized(docs: DataFrame, path: str, pattern: str, context: int = CONTEXT) -> DataFrame:
    """The pieces of every document with the CRC of their ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path, pattern)
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                rows += [(key, i, s, e - s, zlib.crc32(ids[s:e].tobytes())) for i, (s, e) in enumerate(cut(ids, context))]
            columns = [*zip(*rows, strict=True)] or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    return map_arrow(spread(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id"), work, PIECES)


def patterns(histogram: np.ndarray, most: int) -> np.ndarray:
    """(n, 3) lengths of patterns of two (padded with 0) or three lengths that are there and fill a sequence."""
    full = len(histogram) - 1
    there = np.flatnonzero(histogram)
    there = there[(there > 0) & (there < full)]
    pairs = there[(there * 2 <= full) & (histogram[full - there] > 0)]
    out = [np.stack([pairs, full - pairs, np.zeros_like(pairs)], 1)]
    room, firsts = most - len(pairs), there[there * 3 <= full]
    triples = []
    for a in firsts:
        b = there[(there >= a) & (there * 2 <= full - a)]
        b = b[histogram[full - a - b] > 0]
        triples.append(np.stack([np.full_like(b, a), b, full - a - b], 1))
    if triples:
        every = np.concatenate(triples)
        if len(every) > max(room, 0):
            value = np.minimum(np.minimum(histogram[every[:, 0]], histogram[every[:, 1]]), histogram[every[:, 2]])
            mixed = (every[:, 0] * 2654435761 + every[:, 1] * 40503) % 65536
            every = every[np.lexsort((mixed, -value))[: max(room, 0)]]
        out.append(every)
    return np.concatenate(out)


def fit(histogram: np.ndarray, forms: np.ndarray, steps: int = 200) -> np.ndarray:
    """Non-negative repeat counts x of the patterns that bring A x nearest to the histogram (accelerated projected gradient)."""
    h = histogram.astype(float).copy()
    h[0] = 0
    size = len(h)

    def times(x):
        out = sum(np.bincount(forms[:, j], x, size) for j in range(3))
        out[0] = 0
        return out

    x = y = np.zeros(len(forms))
    use = np.maximum(times(np.ones(len(forms))), 1)
    inverse = 1 / np.maximum(np.max(np.stack([use[forms[:, j]] for j in range(2)]), 0) * 3, 1)
    t = 1.0
    for _ in range(steps):
        r = h - times(y)
        r[0] = 0
        new = np.maximum(y + inverse * (r[forms[:, 0]] + r[forms[:, 1]] + r[forms[:, 2]]), 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


class Plan:
    """Places for counts of lengths: rows (length, first rank, count, first sequence, pieces in a sequence, offset)."""

    def __init__(self, full: int):
        self.full, self.rows, self.sequences, self.used = full, [], 0, np.zeros(full + 1, np.int64)

    def put(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        self.rows.append((length, int(self.used[length]), count, sequence, each, offset))
        self.used[length] += count

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count


def best_fit(plan: Plan, left: np.ndarray) -> None:
    """Best-fit decreasing on counts: each length goes to the tightest open space, else to new sequences."""
    full = plan.full
    spaces: list[list[tuple[int, int]]] = [[] for _ in range(full + 1)]
    open_ = np.zeros(full + 1, bool)

    def keep(space: int, sequence: int, count: int) -> None:
        if space and count:
            spaces[space].append((sequence, count))
            open_[space] = True

    for length in np.flatnonzero(left)[::-1].tolist():
        count = int(left[length])
        while count:
            fits = np.flatnonzero(open_[length:])
            if len(fits):
                space = length + int(fits[0])
                sequence, many = spaces[space].pop()
                open_[space] = bool(spaces[space])
            else:
                space = full
                many = -(-count // (full // length))
                sequence = plan.open(many)
            each = space // length
            filled = min(many, count // each)
            if filled:
                plan.put(length, filled * each, sequence, each, full - space)
                keep(space - each * length, sequence, filled)
                count -= filled * each
            if filled < many:
                some = min(count, each)
                if some:
                    plan.put(length, some, sequence + filled, some, full - space)
                    keep(space - some * length, sequence + filled, 1)
                    count -= some
                    filled += 1
                keep(space, sequence + filled, many - filled)


def planned(histogram: np.ndarray) -> Plan:
    """The plan for histogram[length] pieces of each length up to len(histogram) - 1."""
    full = len(histogram) - 1
    plan, left = Plan(full), histogram.astype(np.int64).copy()
    if left[full]:
        n = int(left[full])
        plan.put(full, n, plan.open(n), 1, 0)
        left[full] = 0
    forms = patterns(left, int(np.clip(left.sum() // PIECES_PER_PATTERN, LEAST_PATTERNS, MOST_PATTERNS)))
    if len(forms):
        x = fit(left, forms)
        for i in np.lexsort((np.arange(len(x)), -x)).tolist():
            want = int(x[i] + 0.5)
            if not want:
                break
            lengths = [int(v) for v in forms[i] if v]
            need = {v: lengths.count(v) for v in lengths}
            want = min(want, *(int(left[v]) // c for v, c in need.items()))
            if want:
                sequence, offset = plan.open(want), 0
                for v in sorted(lengths, reverse=True):
                    plan.put(v, want, sequence, 1, offset)
                    left[v] -= want
                    offset += v
    best_fit(plan, left)
    return plan


def packed(docs: DataFrame, path: str, pattern: str, context: int = CONTEXT) -> DataFrame:
    """Every piece with its sequence and its place there."""
    pieces = checkpointed(tokenized(docs, path, pattern, context))
    histogram = np.zeros(context + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most context rows
        histogram[length] = n
    plan = planned(histogram)
    rows = pa.table(dict(zip(("len", "lo", "n", "first", "each", "at"), map(list, zip(*plan.rows or [(0,) * 6], strict=True)), strict=True)))
    places = F.broadcast(docs.sparkSession.createDataFrame(rows))  # bounded by the patterns and lengths
    ranked = numbered(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "rank")
    here = (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("lo") + F.col("n"))
    nth = F.col("rank") - F.col("lo")
    return ranked.join(places, here).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )
