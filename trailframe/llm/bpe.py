"""Byte-level BPE encoding and decoding with recursive DuckDB queries, one database per Python worker.

A text is cut into pieces by the vocabulary's pattern, and pieces into segments wherever no token of the vocabulary can
reach across. Distinct segments become rows (position, token, next position and token, rank of the pair), first one row
for each byte. Each step of a recursive query contracts the pair of least rank of each segment at all its occurrences
from the left and looks the new pairs up in the merge table, until no pair is left. In a vocabulary whose tokens are all
made by its own merges (a test holds the given one to it) a contraction never makes a pair of lower rank, so these are
the next leftmost minimum-rank contractions in any case; of overlapping occurrences every second one takes part. Segments at
their fixpoint leave the state. Long segments go through a recursion that keeps only the latest state of each position.
Ordered aggregation over (document, position) rows joined with the solved pieces gives a document's ids and decodes them.

Null text counts as empty: no tokens, and the digest of nothing. Copies and ties give equal rows; extra columns are
not read. Texts and words of any length work: state is held for one chunk of texts, one slice of its pieces and a
bounded memo of segments, and the database may spill to the worker's temporary folder.
"""

from __future__ import annotations

import base64
import hashlib
import os
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import map_arrow, spread

#: Characters of text gathered before pieces are solved, bytes of segments in one query, and pieces aggregated at once.
CHUNK_BYTES, QUERY_BYTES, SLICE = 8_000_000, 300_000, 500_000
#: Segments and bytes that a worker remembers beyond those of the latest chunk.
MEMO, MEMO_BYTES = 800_000, 100_000_000
#: Segments of more bytes take the keyed recursion, which keeps no history.
LONG = 64
SOLVED = pa.schema([("n", pa.int64()), ("shown", pa.string()), ("decoded", pa.binary())])
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: The occurrences (g, n, made) of each segment's least pair among the rows of {state} that do not overlap from the left.
_OK = """
    least AS (SELECT w AS lw, min(made) AS low FROM {state} WHERE made IS NOT NULL GROUP BY w),
    live AS (SELECT s.* FROM {state} s JOIN least ON w = lw),
    hit AS (SELECT g, n, made FROM live JOIN least ON w = lw AND made = low),
    clash AS (SELECT h.g FROM hit h SEMI JOIN hit i ON i.n = h.g UNION SELECT h.g FROM hit h SEMI JOIN hit i ON i.g = h.n),
    ok AS (
        SELECT g, n, made FROM hit ANTI JOIN clash USING (g)
        UNION ALL
        SELECT g, n, made FROM (
            SELECT *, row_number() OVER (PARTITION BY run ORDER BY g) AS nth FROM (
                SELECT *, sum(CASE WHEN prev = g THEN 0 ELSE 1 END) OVER (ORDER BY g) AS run FROM (
                    SELECT *, lag(n) OVER (ORDER BY g) AS prev FROM hit SEMI JOIN clash USING (g))))
        WHERE nth % 2 = 1),
    merged AS (SELECT k.g AS kg, k.made AS new, e.n AS en, e.ntok AS etok FROM ok k JOIN live e ON e.g = k.n)"""
#: Ids and bytes of each segment, in its order; one thread keeps the order of the sorted rows.
_SHOWN = """
SELECT n, shown, decoded FROM (
    SELECT w, count(*) AS n, string_agg(tok::VARCHAR, ' ') AS shown, from_hex(string_agg(hex, '')) AS decoded
    FROM (SELECT w, tok, hex FROM {state} JOIN tokens ON tokens.id = state.tok ORDER BY g) GROUP BY w)
ORDER BY w"""
_SEED = "SELECT w, g, tok, n, ntok, m.made{more} FROM seed LEFT JOIN merges m ON m.pair = tok::BIGINT * 65536 + ntok"

#: Every row of the segments that still change is written anew in each step.
FIXPOINT = f"""
WITH RECURSIVE state(w, g, tok, n, ntok, made, step) AS (
    {_SEED.format(more=", 0")}
    UNION ALL (
    WITH {_OK.format(state="state")},
    kept AS (
        SELECT s.w, s.g, coalesce(k.new, s.tok) AS tok, CASE WHEN k.kg IS NULL THEN s.n ELSE k.en END AS n,
            CASE WHEN k.kg IS NULL THEN s.ntok ELSE k.etok END AS ntok, s.step + 1 AS step
        FROM live s LEFT JOIN merged k ON k.kg = s.g ANTI JOIN ok e ON e.n = s.g),
    turned AS (SELECT x.w, x.g, x.tok, x.n, coalesce(k.made, x.ntok) AS ntok, x.step FROM kept x LEFT JOIN ok k ON k.g = x.n)
    SELECT w, g, t.tok, n, t.ntok, m.made, step FROM turned t LEFT JOIN merges m ON m.pair = t.tok::BIGINT * 65536 + t.ntok)
), last AS (SELECT w, max(step) AS step FROM state GROUP BY w)
{_SHOWN.format(state="state JOIN last USING (w, step)")}
"""

#: Only rows at and before a contraction are written; rows that were taken in have no token.
KEYED = f"""
WITH RECURSIVE state(w, g, tok, n, ntok, made) USING KEY (g) AS (
    {_SEED.format(more="")}
    UNION (
    WITH {_OK.format(state="recurring.state")},
    changed AS (
        SELECT s.w, s.g, k.new AS tok, k.en AS n, k.etok AS ntok FROM live s JOIN merged k ON k.kg = s.g
        UNION ALL
        SELECT s.w, s.g, s.tok, s.n, s.ntok FROM live s SEMI JOIN ok k ON k.g = s.n ANTI JOIN ok i ON i.g = s.g ANTI JOIN ok j ON j.n = s.g),
    turned AS (SELECT x.w, x.g, x.tok, x.n, coalesce(k.made, x.ntok) AS ntok FROM changed x LEFT JOIN ok k ON k.g = x.n)
    SELECT w, g, t.tok, n, t.ntok, m.made FROM turned t LEFT JOIN merges m ON m.pair = t.tok::BIGINT * 65536 + t.ntok
    UNION ALL
    SELECT s.w, s.g, NULL, NULL, NULL, NULL FROM live s SEMI JOIN ok k ON k.n = s.g)
)
{_SHOWN.format(state="state")}
"""

#: The ids and the decoded text of each document of a slice; one thread keeps the order of the sorted rows.
AGGREGATED = """
SELECT d, sum(n)::BIGINT AS n, string_agg(shown, ' ') AS shown, string_agg(decoded, '') AS decoded
FROM (SELECT d, n, shown, decoded FROM places JOIN pieces USING (code) ORDER BY p) GROUP BY d ORDER BY d
"""


class RecursiveBpe:
    """Encoder and decoder over one in-memory database; ranks_file and pattern are parameters."""

    def __init__(self, ranks_file: str, pattern: str, memory_limit: str = "350MB"):
        import duckdb
        import regex

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern).findall
        spill = f"{tempfile.gettempdir()}/bpe-{os.getpid()}"
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory_limit, "temp_directory": spill})
        pairs = [(ranks[t[:i]] * 65536 + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pair, made = zip(*pairs, strict=True)
        self._load("merges", pa.table({"pair": pa.array(pair, pa.int64()), "made": pa.array(made, pa.int32())}))
        self._load("tokens", pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": [t.hex() for t in ranks]}))
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.two, self.three = np.zeros((256, 256), bool), np.zeros((256, 256, 256), bool)
        for t in ranks:
            if len(t) == 2:
                self.two[t[0], t[1]] = True
            for i in range(len(t) - 2):
                self.three[t[i], t[i + 1], t[i + 2]] = True
        self.index: dict[bytes, int] = {}
        self.memo = SOLVED.empty_table()

    def _load(self, name: str, data: pa.Table) -> None:
        self.db.register("given", data)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given").fetchall()
        self.db.unregister("given")

    def segments(self, pieces: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """The segments of all pieces in order, and how many each piece has.

        A token reaches from one byte to the next only if the two are a token or are in three bytes of one.
        """
        joined, sizes = b"".join(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        x, ends = np.frombuffer(joined, np.uint8), np.cumsum(sizes)
        border = np.zeros(len(x) + 1, bool)
        border[ends] = True
        bound = np.zeros(len(x) + 1, bool)
        if len(x) > 1:
            bound[1:-1] = self.two[x[:-1], x[1:]]
            within = self.three[x[:-2], x[1:-1], x[2:]] & ~border[1:-2] & ~border[2:-1]
            bound[1:-2] |= within
            bound[2:-1] |= within
        at = np.flatnonzero(border | ~bound)
        at = at[at > 0].tolist()
        counts = np.diff(np.searchsorted(at, np.r_[0, ends], side="right"))
        return [joined[i:j] for i, j in zip([0, *at], at)], counts  # noqa: B905

    def solve(self, segments: list[bytes]) -> pa.Table:
        """Of each distinct segment, shorter ones than LONG first: the number of tokens, the ids as text, and the bytes that they stand for."""
        short = sum(len(s) <= LONG for s in segments)
        out = [SOLVED.empty_table()]
        for query, some in ((FIXPOINT, segments[:short]), (KEYED, segments[short:])):
            ends = np.cumsum([len(s) for s in some])
            parts = np.flatnonzero(np.diff(ends // QUERY_BYTES)) + 1 if some else []
            out += [self._fixpoint(query, some[i:j]) for i, j in zip([0, *parts], [*parts, len(some)], strict=True) if j > i]
        return pa.concat_tables(out)

    def _fixpoint(self, query: str, segments: list[bytes]) -> pa.Table:
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        tok = self.byte_ids[np.frombuffer(b"".join(segments), np.uint8)]
        last = np.zeros(len(tok), bool)
        last[np.cumsum(sizes) - 1] = True
        g = np.arange(len(tok), dtype=np.int32)
        w = np.repeat(np.arange(len(segments), dtype=np.int32), sizes)
        self._load("seed", pa.table({"w": w, "g": g, "tok": tok, "n": pa.array(g + 1, mask=last), "ntok": pa.array(np.append(tok[1:], np.int32(0)), mask=last)}))
        return self.db.sql(query).to_arrow_table().cast(SOLVED)

    def known(self, segments: list[bytes]) -> np.ndarray:
        """The row of the memo for each segment; a full memo keeps what these segments use."""
        fresh = sorted({s for s in segments if s not in self.index}, key=lambda s: len(s) > LONG)
        if len(self.index) + len(fresh) > MEMO or self.memo.nbytes > MEMO_BYTES:
            used = {s: self.index[s] for s in segments if s in self.index}
            self.memo, self.index = self.memo.take(pa.array(used.values(), pa.int64())), dict(zip(used, range(len(used)), strict=True))
        self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh)), strict=True))
        self.memo = pa.concat_tables([self.memo, self.solve(fresh)]).combine_chunks()
        return np.fromiter(map(self.index.__getitem__, segments), np.int64, len(segments))

    def pieces(self, distinct: list[str]) -> pa.Table:
        """(code, n, shown, decoded) of the distinct pieces; code is the place in the list."""
        cut, counts = self.segments([p.encode() for p in distinct])
        at = pa.array(self.known(cut))
        rows = self.memo.take(at)
        starts = np.r_[0, np.cumsum(counts)].astype(np.int32)
        joined = lambda c, by: pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), rows.column(c).combine_chunks()), by)
        n = np.add.reduceat(rows.column("n").to_numpy(), starts[:-1]) if len(distinct) else np.zeros(0, np.int64)
        return pa.table({"code": np.arange(len(distinct), dtype=np.int32), "n": n, "shown": joined("shown", " "), "decoded": joined("decoded", b"").cast(pa.string())})

    def encode(self, texts: list[str]) -> Iterator[tuple[int, int, str, str]]:
        """(index of the text, n, ids as text, decoded text) by text; a long text comes in several parts, an empty one in none."""
        cut = [self.split(t) for t in texts]
        flat = pa.chunked_array([pa.array([p for c in cut for p in c], pa.string())]).combine_chunks().dictionary_encode()
        if isinstance(flat, pa.ChunkedArray):
            flat = flat.unify_dictionaries().combine_chunks()
        self._load("pieces", self.pieces(flat.dictionary.to_pylist()))
        doc = np.repeat(np.arange(len(cut), dtype=np.int32), [len(c) for c in cut])
        for i in range(0, len(doc), SLICE):
            self._load("places", pa.table({"d": doc[i : i + SLICE], "p": np.arange(i, min(i + SLICE, len(doc))), "code": flat.indices[i : i + SLICE]}))
            found = self.db.sql(AGGREGATED).to_arrow_table()
            yield from zip(*(found.column(c).to_pylist() for c in ("d", "n", "shown", "decoded")), strict=True)

    def ids(self, text: str) -> list[int]:
        return [int(x) for _, _, shown, _ in self.encode([text]) for x in shown.split()]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids by ordered aggregation over (position, id) rows."""
        self._load("wanted", pa.table({"p": pa.array(range(len(ids)), pa.int64()), "id": pa.array(ids, pa.int32())}))
        got = self.db.execute("SELECT string_agg(hex, '' ORDER BY p) FROM wanted JOIN tokens USING (id)").fetchall()
        return bytes.fromhex(got[0][0] or "")


@lru_cache(maxsize=1)
def coder(ranks_file: str, pattern: str) -> RecursiveBpe:
    """One coder for each Python worker."""
    return RecursiveBpe(ranks_file, pattern)


def chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of at most about most bytes of text; null text is empty."""
    keys, texts, size = [], [], 0
    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            keys.append(key)
            texts.append(text or "")
            size += len(text or "")
            if size >= most:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def digests(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """Per document the number of tokens and digests of the ids and of the decoded bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_file, pattern)
        for keys, texts in chunks(batches):
            counts, ids, decoded = [0] * len(keys), [hashlib.sha256() for _ in keys], [hashlib.sha256() for _ in keys]
            for d, n, shown, text in bpe.encode(texts):
                ids[d].update((" " * (counts[d] > 0) + shown).encode())
                decoded[d].update(text.encode())
                counts[d] += n
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array([h.hexdigest() for h in ids]), pa.array([h.hexdigest() for h in decoded]),
            ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(spread(docs.select("doc_id", "text"), "doc_id"), work, SCHEMA)


def encoded(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """Per document its ids and the bytes decoded from them: the operator's real output."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_file, pattern)
        for keys, texts in chunks(batches, CHUNK_BYTES // 4):
            ids, decoded = [[] for _ in keys], [[] for _ in keys]
            for d, _, shown, text in bpe.encode(texts):
                ids[d] += map(int, shown.split())
                decoded[d].append(text.encode())
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([b"".join(x) for x in decoded], pa.binary()),
            ], names=["doc_id", "ids", "decoded"])

    return map_arrow(docs.select("doc_id", "text"), work, "doc_id long, ids array<int>, decoded binary")
