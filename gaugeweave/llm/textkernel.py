"""Vectorised work on the bytes of many texts at once: words, their hashes, sums over texts.

Texts come as Arrow strings and are cut into chunks of about half a megabyte at text boundaries, so that every temporary
array stays small; a longer text is a chunk by itself and is used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)

#: Bytes of words: ASCII letters and digits, the underscore, and all bytes of characters beyond ASCII.
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")] = True
IN_WORD[128:] = True


def chunks(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets): texts first..last-1 are bytes[offsets[i]:offsets[i + 1]]; a null text has no bytes."""
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
    if lower:
        texts = pc.utf8_lower(texts)
    large = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + CHUNK, "right")) - 1)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n in _CACHE:
        return _CACHE[n]
    up = np.full(n, BASE, dtype=U)
    down = np.full(n, U(pow(int(BASE), -1, 1 << 64)), dtype=U)
    up[0] = down[0] = U(1)
    made = np.multiply.accumulate(up), np.multiply.accumulate(down)
    if n <= 2 * CHUNK:
        _CACHE[n] = made
    return made


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text): the byte range of every word and the number of its text in the chunk."""
    inside = IN_WORD[data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.zeros(len(inside) + 1, dtype=bool)
    fresh[offs] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (~before | fresh[:-1]))
    ends = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, the same wherever the bytes stand."""
    up, down = _powers(1 << max(19, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def shingles(hashes: np.ndarray, text: np.ndarray, n_texts: int, n: int = 5) -> list[np.ndarray]:
    """The distinct hashes of each text's runs of n words; of all its words, if it has fewer; none, if it has none."""
    bounds = np.searchsorted(text, np.arange(n_texts + 1))
    run = np.zeros(max(0, len(hashes) - n + 1), dtype=U)
    for k in range(n):
        run = run * BASE + hashes[k : k + len(run)]
    run = mix(run)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(run[a : b - n + 1]))
        elif b > a:
            h = np.zeros(1, dtype=U)
            for x in hashes[a:b]:
                h = h * BASE + x
            out.append(mix(h + U(b - a)))
        else:
            out.append(np.zeros(0, dtype=U))
    return out


def sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of values[offs[i]:offs[i + 1]] along the first axis, 0 for empty ranges."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]
