"""Words, shingles and min-wise signatures of whole text batches, vectorised over bytes.

A word's hash is a polynomial in its bytes modulo 2**64, taken from one running sum over the batch, then mixed.
Sixty-four bits tell the words and shingles of any corpus this library can hold apart but for a chance below 2**-20.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
CHUNK = 1 << 20  # bytes that are worked on at a time
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, at least ``n`` of each."""
    if n <= len(_powers[0]):
        return _powers[0], _powers[1]
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(max(n, CHUNK + 1), base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    if n <= CHUNK + 1:  # longer ones, for a single word of that size, are not kept
        _powers[:] = out
    return out[0], out[1]


PUNCTUATION = SPACE.copy()
PUNCTUATION[[b for b in range(128) if not chr(b).isalnum()]] = True


def words(texts: list[bytes | None], gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and where each text's words begin (one more entry than texts).

    Words are maximal runs of bytes that ``gaps`` (a table over bytes, ASCII white space by default) doesn't hold,
    with A-Z lower-cased.  Bytes are worked off in chunks that end in a gap, so working memory doesn't grow with a text.
    """
    sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    data = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
    first = np.concatenate(([0], np.cumsum(sizes + 1)))
    found, starts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and not gaps[data[end - 1]]:
            gap = np.flatnonzero(gaps[data[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
            else:  # a word that fills the chunk
                end = min(len(data), at + 2 * (end - at))
        hashes, start = _chunk(data[at:end], gaps)
        found.append(hashes)
        starts.append(start + at)
        at = end
    return np.concatenate(found), np.searchsorted(np.concatenate(starts), first)


def _chunk(data: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of bytes that end in a gap, or with the last text."""
    edge = np.diff(gaps[data].view(np.int8), prepend=np.int8(1), append=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[LOWER[data]] * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)), start


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of ``width`` consecutive words; of the whole sequence if it has fewer words."""
    w, at = words(texts)
    grams = w.copy()
    for k in range(1, width):
        grams[: len(w) - k] = mix(grams[: len(w) - k] * np.uint64(0x9E3779B97F4A7C15) + w[k:])
    out = []
    for s, e in zip(at[:-1], at[1:], strict=True):
        if e - s >= width:
            out.append(np.unique(grams[s : e - width + 1]))
        elif e > s:
            whole = w[s : s + 1]
            for k in range(s + 1, e):  # fewer than ``width``
                whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + w[k : k + 1])
            out.append(mix(whole ^ np.uint64(e - s)))
        else:
            out.append(w[:0])
    return out


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """``size`` min-wise values of each non-empty set, as 32-bit numbers; rows of empty sets are all ones."""
    out = np.full((len(sets), size), 0xFFFFFFFF, np.uint32)
    full = [k for k, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[k] for k in full])
        at = np.concatenate(([0], np.cumsum([len(sets[k]) for k in full])[:-1]))
        seeds = mix(np.arange(1000, 1000 + size, dtype=np.uint64)) | np.uint64(1)
        for k in range(size):
            v = flat * seeds[k]
            v ^= v >> np.uint64(29)
            v *= np.uint64(0xBF58476D1CE4E5B9)
            out[full, k] = np.minimum.reduceat((v >> np.uint64(32)).astype(np.uint32), at)
    return out


def text_batches(column, most: int = 1 << 20, rows: int = 256):
    """Runs of an Arrow string column, as (first row, texts as bytes), of about ``most`` bytes and at most ``rows`` rows.

    One text longer than ``most`` is a run of its own.  Only one run is held at a time.
    """
    begin, size, held = 0, 0, []
    for k, x in enumerate(column):
        x = x.as_py()
        t = None if x is None else x.encode("utf-8", "surrogatepass")
        if held and (size + len(t or b"") > most or len(held) == rows):
            yield begin, held
            begin, size, held = k, 0, []
        held.append(t)
        size += len(t or b"")
    if held:
        yield begin, held
    pa.default_memory_pool().release_unused()
