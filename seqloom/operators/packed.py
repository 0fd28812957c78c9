"""Columns of whole numbers as bytes, dealt to tasks by number: a row that travels holds thousands of entries."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that are sorted and packed at once.
ROWS = 1 << 20
#: Tokens of a text that are a row.
STRETCH = 512
#: Odd multipliers that spread numbers.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length: differences of neighbours, the same byte of all together, compressed."""
    n, out = len(columns[0]), []
    for c in columns:
        d = np.diff(np.asarray(c).astype(np.int64, copy=False), prepend=np.int64(0))  # wraps around, as does the sum
        out.append(np.ascontiguousarray(((d << 1) ^ (d >> 63)).view(np.uint8).reshape(-1, 8).T))
    return struct.pack("<I", n) + pa.compress(b"".join(x.tobytes() for x in out), codec="zstd", asbytes=True)


def unpack(blob: bytes, k: int) -> np.ndarray:
    """The ``k`` columns of a blob, as rows of int64."""
    n = struct.unpack_from("<I", blob)[0]
    if not n:
        return np.zeros((k, 0), np.int64)
    raw = np.frombuffer(pa.decompress(memoryview(blob)[4:], decompressed_size=8 * n * k, codec="zstd", asbytes=True), np.uint8)
    z = np.ascontiguousarray(raw.reshape(k, 8, n).transpose(0, 2, 1)).view(np.uint64)[:, :, 0]
    return np.cumsum((z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64), axis=1)


def unpacked(blobs: Sequence[bytes], k: int) -> np.ndarray:
    return np.concatenate([np.zeros((k, 0), np.int64), *(unpack(b, k) for b in blobs)], axis=1)


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` even ranges of unsigned 64-bit numbers each is in."""
    return ((hashes.view(np.uint64) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def spread(numbers: np.ndarray, k: int = 0) -> np.ndarray:
    """Numbers as evenly spread unsigned ones, in one of four ways."""
    x = numbers.view(np.uint64) * ODD[k]
    return (x ^ (x >> np.uint64(29))) * ODD[k - 1]


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins in columns sorted together."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first, first + 1, ...``, ``count`` of them, one range after another."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def token_places(batch: pa.RecordBatch, fan_out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and place of each token with the next ``fan_out`` ones, of stretches ``(at, w)`` of token hashes; those past ``STRETCH`` only follow."""
    length = pc.list_value_length(batch.column("w")).to_numpy()
    w, row = batch.column("w").flatten().to_numpy(), np.repeat(np.arange(len(batch)), length)
    place = np.arange(len(w)) - (np.cumsum(length) - length)[row]
    left, place_of, out = length[row] - place, batch.column("at").to_numpy()[row] + place, []
    for lag in range(1, fan_out + 1):
        i = np.flatnonzero((left > lag) & (place < STRETCH))
        out.append((row[i], spread((spread(w[i], lag % 4) ^ w[i + lag].view(np.uint64)) + np.uint64(lag)).view(np.int64), place_of[i]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def postings(batches: Iterator[pa.RecordBatch], fan_out: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """``hash, no, pos, inside`` of some places at a time: of rows ``(no, low, high, hash, pos)``, or of stretches with ``fan_out``."""
    for batch in batches:
        for i in range(0, len(batch), 256 if fan_out else len(batch)):
            part = batch.slice(i, 256) if fan_out else batch
            row, h, pos = token_places(part, fan_out) if fan_out else (slice(None), part.column("hash").to_numpy(), part.column("pos").to_numpy())
            no, low, high = (part.column(c).to_numpy()[row] for c in ("no", "low", "high"))
            yield h, no, pos, (pos >= low) & (pos < high)


def gathered(parts: Iterator[tuple[np.ndarray, ...]], rows: int = ROWS) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of ``rows`` entries or somewhat more at a time."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= rows:
            whole, held, n = tuple(np.concatenate(x) for x in zip(*held, strict=True)), [], 0
            yield whole
            del whole
            pa.default_memory_pool().release_unused()
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def dealt(key: np.ndarray, *columns: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Keys in ascending order, and a blob for each."""
    first = runs(key)
    ends = np.r_[first[1:], len(key)]
    return key[first].tolist(), [pack(*(c[a:b] for c in columns)) for a, b in zip(first, ends, strict=True)]


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Blobs ``(bucket, x)`` of a task, which holds all those of its buckets."""
    found: dict[int, list[bytes]] = {}
    for batch in batches:
        for k, x in zip(batch.column("bucket").to_pylist(), batch.column("x").to_pylist(), strict=True):
            found.setdefault(k, []).append(x)
    while found:
        yield found.popitem()
