"""FLAC encoding and decoding of mono and multi-channel PCM in vectorized numpy.

Frames are coded in lockstep: one numpy step reads the same sample of many frames, so Rice codes and linear
predictors are decoded without a Python loop over samples. Frames carry CRC-8 and CRC-16, the stream an MD5 of its
samples and a seek point for each frame.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np

BLOCK = 4096
#: Fixed values of the format: binomial predictors of order 0 to 4, block sizes and sample sizes by code.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
BLOCK_SIZES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


class FlacError(ValueError):
    """A stream that is not FLAC, is cut short or fails a checksum."""


@lru_cache(maxsize=4)
def crc_table(bits: int, poly: int) -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        t = np.where(t >> (bits - 1) & 1, (t << 1) ^ poly, t << 1) & ((1 << bits) - 1)
    return t


def crc8(data: bytes) -> int:
    t, c = crc_table(8, 0x07), 0
    for b in data:
        c = int(t[c ^ b])
    return c


_far = np.zeros((0, 256), np.uint16)


def crc16_many(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each data[start:end], as the XOR of what each byte gives at its distance from the end."""
    global _far
    sizes = ends - starts
    if len(starts) == 0:
        return np.zeros(0, np.uint16)
    if (most := int(sizes.max())) > len(_far):
        t, rows = crc_table(16, 0x8005), [*_far] or [crc_table(16, 0x8005).astype(np.uint16)]
        while len(rows) < most + 1024:
            v = rows[-1].astype(np.uint32)
            rows.append((t[v >> 8] ^ (v << 8 & 0xFFFF)).astype(np.uint16))
        _far = np.array(rows)
    firsts = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) + np.repeat(starts - firsts, sizes)
    away = np.repeat(ends, sizes) - 1 - at
    return np.bitwise_xor.reduceat(_far.ravel()[away * 256 + data[at]], firsts)


def utf8_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    tail = []
    while n >= 1 << (6 - len(tail)):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF00 >> (len(tail) + 1)) & 0xFF | n, *reversed(tail)])


def _rice_parameters(u: np.ndarray, n: np.ndarray | int, top: int = 14) -> tuple[np.ndarray, np.ndarray]:
    """The best parameter of each row of non-negative u, and the bits that its codes take."""
    guess = np.clip(np.log2(np.maximum(u.sum(1) / np.maximum(n, 1) * 0.7, 1e-9)), 0, top).astype(np.int64)
    best, cost = guess, (u >> guess[:, None]).sum(1) + n * (1 + guess)
    for k in (np.maximum(guess - 1, 0), np.minimum(guess + 1, top)):
        c = (u >> k[:, None]).sum(1) + n * (1 + k)
        best, cost = np.where(c < cost, k, best), np.minimum(c, cost)
    return best, cost


def encode_frames(x: np.ndarray, numbers: list[int], bps: int = 8, lpc: tuple[np.ndarray, int] | None = None, partitions: int = 0) -> list[bytes]:
    """Frames of the rows of x (frames, samples), all of one size. lpc: (coefficients, shift) to use, else fixed predictors."""
    count, n = x.shape
    x = x.astype(np.int64)
    parts = partitions if n % (1 << partitions) == 0 and n >> partitions > 32 else 0
    if lpc is not None and n > len(lpc[0]):
        coef, shift = np.asarray(lpc[0], np.int64), lpc[1]
        order = np.full(count, len(coef))
        pred = sum(c * x[:, len(coef) - 1 - j : n - 1 - j] for j, c in enumerate(coef)) >> shift
        r = np.concatenate([x[:, : len(coef)], x[:, len(coef) :] - pred], 1)
    else:
        lpc, coef = None, ()
        diffs, order = [x], np.zeros(count, np.int64)
        for _ in range(min(4, n - 1)):
            diffs.append(np.diff(diffs[-1], axis=1, prepend=0))
        size = np.array([np.abs(d[:, min(4, n - 1) :]).sum(1) for d in diffs])
        order = size.argmin(0)
        r = diffs[0].copy()
        for o in range(1, len(diffs)):
            r[order == o] = diffs[o][order == o]
    warm = np.arange(n)[None, :] < order[:, None]
    u = np.where(warm, 0, (r << 1) ^ (r >> 63))
    rows = u.reshape(count << parts, n >> parts)
    k, _ = _rice_parameters(rows, (~warm).reshape(rows.shape).sum(1))
    k2 = np.repeat(k.reshape(count, 1 << parts), n >> parts, axis=1)
    lengths = np.where(warm, 0, (u >> k2) + 1 + k2)
    first_of_part = np.zeros((1, n), np.int64)
    first_of_part[0, :: n >> parts] = 4
    heads = []
    for f in range(count):
        size_code = 12 if n == 4096 else 7
        head = bytes([0xFF, 0xF8, size_code << 4, {8: 1, 12: 2, 16: 4, 20: 5, 24: 6}[bps] << 1]) + utf8_number(numbers[f]) + (b"" if size_code == 12 else struct.pack(">H", n - 1))
        head += bytes([crc8(head)])
        o = int(order[f])
        bits = f"0{(0b100000 | (o - 1)) if lpc else (0b001000 | o):06b}0" + "".join(f"{int(v) & ((1 << bps) - 1):0{bps}b}" for v in x[f, :o])
        if lpc:
            bits += f"{14:04b}{shift:05b}" + "".join(f"{int(c) & 0x7FFF:015b}" for c in coef)
        heads.append(np.concatenate([np.unpackbits(np.frombuffer(head, np.uint8)), np.frombuffer((bits + f"00{parts:04b}").encode(), np.uint8) - 48]))
    head_bits = np.array([len(h) for h in heads])
    verbatim_bits = 8 + n * bps
    body = lengths.sum(1) + (4 << parts)
    total = -(-(head_bits + body) // 8) * 8 + 16
    base = np.cumsum(total) - total
    out = np.zeros(int(total.sum()), np.uint8)
    for f in range(count):
        out[base[f] : base[f] + head_bits[f]] = heads[f]
    steps = lengths + first_of_part
    start = (base + head_bits)[:, None] + np.cumsum(steps, 1) - steps
    at = start[:, :: n >> parts]
    for b in range(4):
        out[at + (3 - b)] = (k.reshape(at.shape) >> b) & 1
    live = ~warm
    one = (start + first_of_part + (u >> k2))[live]
    out[one] = 1
    uu, kk = u[live], k2[live]
    for b in range(int(k.max(initial=0))):
        has = kk > b
        out[one[has] + kk[has] - b] = (uu[has] >> b) & 1
    packed = np.packbits(out)
    starts, ends = base // 8, (base + total) // 8
    crc = crc16_many(packed, starts, ends - 2)
    packed[ends - 2], packed[ends - 1] = crc >> 8, crc & 0xFF
    frames = [packed[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    for f in np.flatnonzero((total - head_bits - 16 > verbatim_bits) if lpc is None else np.zeros(count, bool)):
        head = bytes([0xFF, 0xF8, (12 if n == 4096 else 7) << 4, {8: 1, 12: 2, 16: 4, 20: 5, 24: 6}[bps] << 1]) + utf8_number(numbers[f]) + (b"" if n == 4096 else struct.pack(">H", n - 1))
        bits = "00000010" + "".join(f"{int(v) & ((1 << bps) - 1):0{bps}b}" for v in x[f])
        plain = head + bytes([crc8(head)]) + np.packbits(np.frombuffer(bits.encode(), np.uint8) - 48).tobytes()
        data = np.frombuffer(plain, np.uint8)
        frames[f] = plain + struct.pack(">H", int(crc16_many(data, np.array([0]), np.array([len(data)]))[0]))
    return frames


def encode(payloads: list[bytes], block: int = BLOCK, **how) -> list[bytes]:
    """One stream for each payload of unsigned 8-bit samples; equal payloads give equal streams."""
    cut: dict[int, list[tuple[int, int]]] = {}
    for i, p in enumerate(payloads):
        for a in range(0, len(p), block):
            cut.setdefault(min(block, len(p) - a), []).append((i, a))
    frames: dict[tuple[int, int], bytes] = {}
    for n, places in cut.items():
        step = max(1, 1_000_000 // n)
        for j in range(0, len(places), step):
            some = places[j : j + step]
            x = np.frombuffer(b"".join(payloads[i][a : a + n] for i, a in some), np.uint8).reshape(-1, n).astype(np.int16) - 128
            frames.update(zip(some, encode_frames(x, [a // block for _, a in some], **how), strict=True))
    return [container([frames[i, a] for a in range(0, len(p), block)], p, block) for i, p in enumerate(payloads)]


def container(frames: list[bytes], payload: bytes, block: int) -> bytes:
    """Stream header, seek table and frames."""
    sizes = [len(f) for f in frames] or [0]
    md5 = hashlib.md5((np.frombuffer(payload, np.uint8) ^ 128).tobytes()).digest()
    packed = 8000 << 44 | 0 << 41 | 7 << 36 | len(payload)
    info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + struct.pack(">Q", packed) + md5
    at, points = 0, []
    for k, f in enumerate(frames):
        points.append(struct.pack(">QQH", k * block, at, min(block, len(payload) - k * block)))
        at += len(f)
    table = b"".join(points)
    return b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(frames)


def header(stream: bytes) -> dict:
    """Stream parameters, the seek points and where frames begin."""
    if stream[:4] != b"fLaC":
        raise FlacError("no fLaC marker")
    at, out, last = 4, {"points": []}, False
    while not last:
        if at + 4 > len(stream):
            raise FlacError("metadata is cut short")
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        last, kind, body = bool(kind & 0x80), kind & 0x7F, stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = struct.unpack(">Q", body[10:18])[0]
            out |= {"block": struct.unpack(">H", body[2:4])[0], "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bps": (packed >> 36 & 31) + 1, "total": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            out["points"] = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
        at += 4 + size
    if "total" not in out:
        raise FlacError("no stream parameters")
    return out | {"start": at}


def _words(buf: np.ndarray) -> np.ndarray:
    """The 64 bits from each byte of buf on."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    w = np.zeros(len(buf), np.uint64)
    for i in range(8):
        w |= padded[i : i + len(buf)].astype(np.uint64) << np.uint64(56 - 8 * i)
    return w


class _Bits:
    """Bit cursors of many frames in one buffer."""

    def __init__(self, buf: np.ndarray):
        self.words, self.size = _words(np.concatenate([buf, np.zeros(16, np.uint8)])), len(buf)

    def window(self, pos: np.ndarray) -> np.ndarray:
        at = np.minimum(pos >> 3, len(self.words) - 1)
        return self.words[at] << (pos & 7).astype(np.uint64)

    def take(self, pos: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """n bits (0 to 33 at most) of each cursor as unsigned numbers; pos moves on."""
        n = np.broadcast_to(np.asarray(n, np.int64), pos.shape)
        w = self.window(pos)
        pos += n
        return np.where(n > 0, w >> np.minimum(64 - n, 63).astype(np.uint64), 0).astype(np.int64)

    def signed(self, pos: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        v = self.take(pos, n)
        n = np.asarray(n, np.int64)
        return v - ((v >> np.maximum(n - 1, 0) & 1) << n)

    def rice(self, pos: np.ndarray, k: np.ndarray) -> np.ndarray:
        """One Rice code of each cursor, as a signed number; pos moves on."""
        w = self.window(pos)
        q = 53 - np.frexp((w >> np.uint64(11)).astype(np.float64))[1].astype(np.int64)
        far = (w >> np.uint64(24)) == 0
        if far.any():
            for i in np.flatnonzero(far):
                p = int(pos[i])
                while p < self.size * 8 and not int(self.words[p >> 3]) << (p & 7) & (1 << 63):
                    p += 1
                if p >= self.size * 8:
                    raise FlacError("a code is cut short")
                q[i] = p - int(pos[i])
            pos += q + 1
            u = q << k | self.take(pos, k)
        else:
            u = q << k | np.where(k > 0, (w << (q + 1).astype(np.uint64)) >> np.minimum(64 - k, 63).astype(np.uint64), 0).astype(np.int64)
            pos += q + 1 + k
        return (u >> 1) ^ -(u & 1)


def _residual(bits: _Bits, pos: np.ndarray, n: np.ndarray, order: np.ndarray, out: np.ndarray) -> None:
    """Residuals of subframes sorted by falling n, into out[:, order:n]."""
    method, parts = bits.take(pos, 2), bits.take(pos, 4)
    if (method > 1).any():
        raise FlacError("unknown residual method")
    wide = np.where(method == 1, 5, 4)
    span = n >> parts
    k, raw = np.zeros(len(n), np.int64), np.full(len(n), -1)
    at = np.arange(int(n.max(initial=0)))
    counts = np.searchsorted(-n, -at, side="left")  # how many subframes are longer than i
    firsts = {int(i) for s, m in set(zip(span.tolist(), n.tolist(), strict=True)) for i in range(0, m, max(s, 1))}
    starts = int(order.max(initial=0))
    for i, c in enumerate(counts.tolist()):
        if i in firsts:
            new = np.flatnonzero(i % np.maximum(span[:c], 1) == 0)
            p = pos[new]
            k[new] = bits.take(p, wide[new])
            escape = k[new] == (1 << wide[new]) - 1
            size = bits.take(p, np.where(escape, 5, 0))
            raw[new] = np.where(escape, size, -1)
            pos[new] = p
        plain = i >= starts and not (raw[:c] >= 0).any()
        if plain:
            out[:c, i] = bits.rice(pos[:c], k[:c])
            continue
        live = np.flatnonzero((i >= order[:c]) & (raw[:c] < 0))
        p = pos[live]
        out[live, i] = bits.rice(p, k[live]) if len(live) else 0
        pos[live] = p
        live = np.flatnonzero((i >= order[:c]) & (raw[:c] >= 0))
        p = pos[live]
        out[live, i] = bits.signed(p, raw[live]) if len(live) else 0
        pos[live] = p


def _subframes(bits: _Bits, pos: np.ndarray, n: np.ndarray, bps: np.ndarray) -> np.ndarray:
    """Samples (subframes, longest) of subframes sorted by falling n; pos moves to their ends."""
    out = np.zeros((len(n), int(n.max(initial=0))), np.int64)
    kind = bits.take(pos, 8) >> 1 & 0x7F
    wasted = np.zeros(len(n), np.int64)
    flag = bits.window(pos - 1) >> np.uint64(63) == 1
    for i in np.flatnonzero(flag):
        p = pos[i : i + 1]
        while True:
            wasted[i] += 1
            if bits.take(p, 1)[0]:
                break
    bps = bps - wasted
    for i in np.flatnonzero(kind == 0):
        out[i, : n[i]] = bits.signed(pos[i : i + 1], bps[i])
    for i in np.flatnonzero(kind == 1):
        at = pos[i] + np.arange(n[i]) * bps[i]
        out[i, : n[i]] = bits.signed(at, bps[i])
        pos[i] += n[i] * bps[i]
    if (bad := ~((kind <= 1) | (kind >> 3 == 1) & (kind & 7 <= 4) | (kind >> 5 == 1))).any():
        raise FlacError(f"reserved subframe type {int(kind[bad][0])}")
    coded = np.flatnonzero(kind > 1)
    if len(coded):
        p, m, size, is_lpc = pos[coded], n[coded], bps[coded], kind[coded] >> 5 == 1
        order = np.where(is_lpc, (kind[coded] & 31) + 1, kind[coded] & 7)
        x = np.zeros((len(coded), int(m.max())), np.int64)
        for j in range(int(order.max(initial=0))):
            has = np.flatnonzero(order > j)
            q = p[has]
            x[has, j] = bits.signed(q, size[has])
            p[has] = q
        coef, shift = np.zeros((len(coded), 32), np.int64), np.zeros(len(coded), np.int64)
        lp = np.flatnonzero(is_lpc)
        if len(lp):
            q = p[lp]
            precision = bits.take(q, 4) + 1
            shift[lp] = bits.signed(q, 5)
            for j in range(int(order[lp].max())):
                has = order[lp] > j
                r = q[has]
                coef[lp[has], j] = bits.signed(r, precision[has])
                q[has] = r
            p[lp] = q
        _residual(bits, p, m, order, x)
        for o in range(1, 5):
            rows = np.flatnonzero(~is_lpc & (order == o))
            if len(rows):
                d = x[rows]
                warm = [d[:, :o].copy()]
                for _ in range(o):
                    warm.append(np.diff(warm[-1], axis=1))
                d = d[:, o:]
                for j in range(o - 1, -1, -1):
                    d = np.cumsum(d, axis=1) + warm[j][:, -1:]
                x[rows, o:] = d
        if len(lp):
            y, c, s, o = x[lp], coef[lp], shift[lp], order[lp]
            top = int(o.max())
            for i in range(1, y.shape[1]):
                w = min(i, top)
                pred = (y[:, i - w : i][:, ::-1] * c[:, :w]).sum(1) >> s
                y[:, i] += np.where(i >= o, pred, 0)
            x[lp] = y
        x *= np.arange(x.shape[1])[None, :] < m[:, None]
        out[coded, : x.shape[1]] = x
        pos[coded] = p
    return out << wasted[:, None]


def decode_frames(buf: np.ndarray, starts: list[int], stream_bps: int = 8, stop: list[int] | None = None) -> tuple[list[np.ndarray], list[int]]:
    """Samples (channels, n) of the frames that begin at starts, and where each ends; checks both checksums."""
    raw, found = buf.tobytes(), []
    for f, a in enumerate(starts):
        if len(raw) < a + 6 or raw[a] != 0xFF or raw[a + 1] & 0xFE != 0xF8:
            raise FlacError(f"no frame at byte {a}")
        size_code, rate_code, chan, bits_code = raw[a + 2] >> 4, raw[a + 2] & 15, raw[a + 3] >> 4, raw[a + 3] >> 1 & 7
        lead = raw[a + 4]
        at = a + 5 + (0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1)
        if size_code in (6, 7):
            n = int.from_bytes(raw[at : at + size_code - 5], "big") + 1
            at += size_code - 5
        elif size_code in BLOCK_SIZES:
            n = BLOCK_SIZES[size_code]
        else:
            raise FlacError("reserved block size")
        at += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
        if crc8(raw[a:at]) != (raw[at] if at < len(raw) else -1):
            raise FlacError(f"header checksum fails at byte {a}")
        found.append((n, f, at + 1, chan, SAMPLE_BITS.get(bits_code, stream_bps)))
    found.sort(key=lambda x: -x[0])
    n, f, at, chan, bps = (np.array(c, np.int64) for c in zip(*found, strict=True))
    bits, pos, channels = _Bits(buf), at * 8, np.where(chan < 8, chan + 1, 2)
    samples: list[list[np.ndarray]] = [[] for _ in found]
    for c in range(int(channels.max())):
        has = np.flatnonzero(channels > c)
        side = (chan[has] == 8) & (c == 1) | (chan[has] == 9) & (c == 0) | (chan[has] == 10) & (c == 1)
        p = pos[has]
        got = _subframes(bits, p, n[has], bps[has] + side)
        pos[has] = p
        for i, row in zip(has.tolist(), got, strict=True):
            samples[i].append(row[: n[i]])
    ends = -(-pos // 8) + 2
    if (ends > len(buf)).any():
        raise FlacError("a frame is cut short")
    crc = crc16_many(buf, np.array(starts, np.int64)[f], ends - 2)
    if (bad := crc != (buf[ends - 2].astype(np.uint16) << 8 | buf[ends - 1])).any():
        raise FlacError(f"frame checksum fails at byte {starts[int(f[bad][0])]}")
    out, stops = [None] * len(found), [0] * len(found)
    for i, x in enumerate(samples):
        if chan[i] == 8:
            x = [x[0], x[0] - x[1]]
        elif chan[i] == 9:
            x = [x[0] + x[1], x[1]]
        elif chan[i] == 10:
            mid = x[0] << 1 | x[1] & 1
            x = [(mid + x[1]) >> 1, (mid - x[1]) >> 1]
        out[f[i]], stops[f[i]] = np.stack(x), int(ends[i])
    return out, stops


def decode(streams: list[bytes], check: bool = True) -> list[list[dict]]:
    """For each stream its blocks {first_sample, byte_offset, pcm (samples, channels)}; with a full seek table all at once."""
    heads = [header(s) for s in streams]
    out: list[list[dict]] = [[] for _ in streams]
    buf = np.frombuffer(b"".join(streams), np.uint8)
    base = np.cumsum([0, *map(len, streams)]).tolist()
    todo = []
    for i, h in enumerate(heads):
        points = h["points"]
        whole = sum(p[2] for p in points) == h["total"] and bool(points)
        todo.append([base[i] + h["start"] + p[1] for p in points] if whole else [base[i] + h["start"]] if h["total"] else [])
    while any(todo):
        jobs = [(i, a) for i, t in enumerate(todo) for a in t]
        todo = [[] for _ in streams]
        frames, ends = [], []
        for j in range(0, len(jobs), 512):
            some = jobs[j : j + 512]
            lo, hi = min(a for _, a in some), max(base[i + 1] for i, _ in some)
            x, e = decode_frames(buf[lo:hi], [a - lo for _, a in some], heads[some[0][0]]["bps"])
            frames += x
            ends += [v + lo for v in e]
        for (i, a), x, e in zip(jobs, frames, ends, strict=True):
            first = sum(b["pcm"].shape[1] for b in out[i][-1:]) + (out[i][-1]["first_sample"] if out[i] else 0)
            out[i].append({"first_sample": first, "byte_offset": a - base[i], "pcm": x})
        for i, a, e in ((i, a, e) for (i, a), e in zip(jobs, ends, strict=True)):
            done = out[i][-1]["first_sample"] + out[i][-1]["pcm"].shape[1]
            if done < heads[i]["total"] and a - base[i] == out[i][-1]["byte_offset"]:
                todo[i] = [e]
    for h, blocks in zip(heads, out, strict=True):
        if check and h["md5"] != bytes(16):
            width = -(-h["bps"] // 8)
            md5 = hashlib.md5()
            for b in blocks:
                md5.update(np.ascontiguousarray(b["pcm"].T.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes())
            if md5.digest() != h["md5"]:
                raise FlacError("sample digest fails")
    return out


def seek(stream: bytes, sample: int) -> tuple[int, int]:
    """(byte offset of the frame that holds the sample, the frame's first sample), by the seek table."""
    h = header(stream)
    if not 0 <= sample < h["total"]:
        raise IndexError(sample)
    first, at, _ = max((p for p in h["points"] if p[0] <= sample), default=(0, 0, 0))
    return h["start"] + at, first
