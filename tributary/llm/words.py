"""Columnar word splitting and hashing over Arrow text batches.

Everything here works on the UTF-8 bytes of a whole batch at once, so a task
spends a few nanoseconds a byte and no Python object is made for a word.  Both
word rules used by the operators have ASCII separators only, hence they can be
applied to the bytes: a byte of 0x80 or more always belongs to a word.

Null texts count as empty.  A word never crosses a document boundary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

K1 = np.uint64(0x9E3779B185EBCA87)
K2 = np.uint64(0xC2B2AE3D27D4EB4F)
S29, S32 = np.uint64(29), np.uint64(32)
LONG_WORD = 128

#: Separators of `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, to be used on lower-cased text.
PUNCT = np.zeros(256, bool)
PUNCT[0x00:0x30] = True
PUNCT[0x3A:0x61] = True
PUNCT[0x7B:0x80] = True

#: Lower-cases A-Z, leaves other bytes alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    """Words of a batch: byte ranges in ``data``, and for each document the range of its words."""

    data: np.ndarray  # uint8
    starts: np.ndarray  # int64, of each word
    ends: np.ndarray
    first: np.ndarray  # int64, number of words before each document; one more than documents
    bytes_first: np.ndarray  # int64, offset of each document's bytes; one more than documents

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        """Index of each word's document."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and the offset of each; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def split(texts: pa.Array | pa.ChunkedArray, separators: np.ndarray = SPACE, lower: bool = False) -> Words:
    data, at = text_bytes(texts)
    if lower:
        data = LOWER[data]
    inside = ~separators[data]
    # A word starts where a word byte follows a separator or a document's start.
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside
    starts = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    after = np.append(inside[1:], False)
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, at), at)


def joined(w: Words, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each, the place of each word there, and its size: a run of words is a slice."""
    size = w.ends - w.starts
    begin = np.cumsum(size + 1) - (size + 1)
    data = np.full(int(begin[-1] + size[-1] + 1) if len(size) else 0, 0x20, np.uint8)
    inside = np.zeros(len(w.data) + 1, np.int8)
    inside[w.starts] += 1
    np.subtract.at(inside, w.ends, 1)
    source = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    raw = w.data[source]
    data[source + np.repeat(begin - w.starts, size)] = LOWER[raw] if lower else raw
    return data, begin, size


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An uneven combination of two hashes; the order matters."""
    h = (a * K1 + b) * K2
    h ^= h >> S29
    h *= K1
    h ^= h >> S32
    return h


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every batch and task."""
    size = w.ends - w.starts
    out = size.astype(np.uint64) * K2
    if not len(size):
        return out
    padded = np.concatenate([w.data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(w.data) + 1,), "<u8", padded, strides=(1,))
    rest, live = size.copy(), np.arange(len(size))
    long = np.flatnonzero(size > LONG_WORD)
    if len(long):
        live = np.flatnonzero(size <= LONG_WORD)
    at = w.starts[live]
    left = rest[live]
    while len(live):
        lane = lanes[at]
        short = left < 8
        bits = (np.minimum(left, 8) * 8).astype(np.uint64)
        lane = np.where(short, lane & ~(np.uint64(0xFFFFFFFFFFFFFFFF) << (bits % np.uint64(64))), lane)
        out[live] = mix(out[live], lane)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in long:
        out[i] = xxhash.xxh3_64_intdigest(w.data[w.starts[i] : w.ends[i]].tobytes(), seed=int(size[i]))
    return out


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words from each word; the last n - 1 words start none. Runs may cross documents."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, length, power, size = None, 0, h, 1
    while True:
        if n & size:
            if out is None:
                out, length = power, size
            else:
                m = len(h) - length - size + 1
                out = mix(power[:m], out[size : size + m])
                length += size
        if length == n:
            return out[: len(h) - n + 1]
        m = len(h) - 2 * size + 1
        power = mix(power[:m], power[size : size + m])
        size *= 2


def starts_of_runs(w: Words, n: int) -> np.ndarray:
    """Whether the run of n words from each word stays in its document, for all words that start a run."""
    last = np.repeat(w.first[1:], w.counts())
    ok = np.arange(len(w)) + n <= last
    return ok[: max(0, len(w) - n + 1)]
