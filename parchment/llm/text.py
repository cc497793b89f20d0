"""Vectorised tokenisation over Arrow string buffers.

A batch's texts stay in one UTF-8 buffer; words are index ranges of it and their hashes are computed with
numpy, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once, which bounds a worker's memory; a single longer text is one piece.
PIECE_BYTES = 1 << 18

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def whitespace_classes() -> np.ndarray:
    """Class of each byte: 0 for the six ASCII spaces, 1 for the rest."""
    out = np.ones(256, np.uint8)
    out[list(SPACES)] = 0
    return out


def letter_classes(punctuation: bool) -> np.ndarray:
    """0 for separators, 1 for ASCII letters, digits and bytes of other scripts, 2 for punctuation (or 0)."""
    out = np.full(256, 2 if punctuation else 0, np.uint8)
    out[list(SPACES)] = 0
    for a, b in (("0", "9"), ("A", "Z"), ("a", "z")):
        out[ord(a) : ord(b) + 1] = 1
    out[128:] = 1
    return out


def lower_bytes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[ord("A") : ord("Z") + 1] += 32
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit counters."""
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


@dataclass
class Words:
    """Words of several texts: byte ranges, 64-bit hashes, and the index of each text's first word."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and where each begins; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, lower: bool = False) -> Words:
    """Maximal runs of bytes of one class other than 0, within each text."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    kind = classes[data]
    change = np.empty(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:n])
    change[0] = change[n] = True
    change[offsets] = True
    inside = kind != 0
    starts = np.flatnonzero(change[:n] & inside)
    ends = np.flatnonzero(change[1:] & inside) + 1
    lens = ends - starts
    at = np.flatnonzero(inside)
    offset = np.arange(len(at)) - np.repeat(np.cumsum(lens) - lens, lens)
    longest = int(lens.max(initial=1))
    powers = np.cumprod(np.full(longest, _MULT, np.uint64))
    values = (lower_bytes()[data[at]] if lower else data[at]).astype(np.uint64) + np.uint64(1)
    values *= powers[offset]
    hashes = np.add.reduceat(values, np.cumsum(lens) - lens) if len(lens) else np.zeros(0, np.uint64)
    return Words(starts, ends, mix(hashes), np.searchsorted(starts, offsets))


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts add up to about ``most`` bytes."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    total = np.cumsum(sizes)
    begin = 0
    while begin < n:
        base = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def word_hashes(texts: pa.Array, classes: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's begin; worked out piece by piece."""
    parts, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for part in pieces(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
        found = words(*buffers(part.column(0)), classes, lower)
        parts.append(found.hashes)
        counts.append(found.counts)
    return np.concatenate(parts), np.cumsum(np.concatenate(counts))


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each text's values; 0 for texts without any."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
