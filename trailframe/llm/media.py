"""Media columns: texts stored as FLAC, read back, checked and cut into PCM blocks with seekable offsets.

The payload of a text is its UTF-8 bytes and zero bytes up to a positive multiple of 64; each byte is one 8-bit mono
sample. Reading checks the CRC-8 of every frame header, the CRC-16 of every frame and the MD5 of all samples, and a
stream that fails raises. Null text counts as empty (64 zero samples). Equal texts give equal streams and features.
Texts of any length work: streams are coded in chunks of bounded size. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flac
from .bpe import chunks
from .common import map_arrow, spread

UNIT, CHUNK_BYTES = 64, 1_500_000
DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
BLOCKS = "doc_id long, block int, first_sample long, n_samples int, byte_offset long, pcm binary"


def payload(text: str | None) -> tuple[int, bytes]:
    """Size of the text's UTF-8 and the padded bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def samples(blocks: list[dict]) -> np.ndarray:
    """All samples of a decoded mono stream."""
    return np.concatenate([b["pcm"][0] for b in blocks])


def feature(x: np.ndarray, blocks: int) -> str:
    """Level, energy and zero crossings of the samples, as whole numbers."""
    x = x.astype(np.int64)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"sum={int(x.sum())};energy={int((x * x).sum())};peak={int(np.abs(x).max())};crossings={crossings};blocks={blocks}"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[int], list[bytes]]]:
    for keys, texts in chunks(batches, CHUNK_BYTES):
        made = [payload(t) for t in texts]
        yield keys, [n for n, _ in made], [p for _, p in made]


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the FLAC stream of every text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sizes, raw in _parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(flac.encode(raw), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """PCM blocks (little-endian, as wide as the samples) of (doc_id, media) with their sample and byte offsets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, stream in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if stream is None:
                    continue
                width = -(-flac.header(stream)["bps"] // 8)
                rows = flac.decode([stream])[0]
                pcm = [np.ascontiguousarray(r["pcm"].T.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays([
                    pa.array([key] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), pa.array([r["first_sample"] for r in rows], pa.int64()),
                    pa.array([r["pcm"].shape[1] for r in rows], pa.int32()), pa.array([r["byte_offset"] for r in rows], pa.int64()), pa.array(pcm, pa.binary()),
                ], names=[c.split()[0] for c in BLOCKS.split(", ")])

    return map_arrow(media.select("doc_id", "media"), work, BLOCKS)


def digests(docs: DataFrame) -> DataFrame:
    """Per document what was stored and what came back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sizes, raw in _parts(batches):
            streams = flac.encode(raw)
            decoded = flac.decode(streams)
            rows = []
            for n, s, blocks in zip(sizes, streams, decoded, strict=True):
                x = samples(blocks)
                back = (x + 128).astype(np.uint8).tobytes()
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(s), hashlib.sha256(s).hexdigest(), feature(x, len(blocks))))
            kinds = [c.split()[1] for c in DIGESTS.split(", ")[1:]]
            columns = [pa.array(c, pa.int64() if k == "long" else pa.string()) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *columns], names=[c.split()[0] for c in DIGESTS.split(", ")])

    return map_arrow(spread(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id"), work, DIGESTS)
