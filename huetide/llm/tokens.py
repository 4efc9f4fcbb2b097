"""Words of many texts at once, as numpy arrays over an Arrow string column.

Texts stay in Arrow's UTF-8 buffer.  Every word class used here is decided by
single bytes (all bytes from 0x80 on belong to words), so one table lookup per
byte finds the words of a whole batch and no Python object per word is made.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once in a task; a longer text is taken alone.
CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words are runs of bytes outside ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Words are runs of ASCII digits, lower-case letters and non-ASCII bytes.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Words of more bytes are hashed one by one.
_LONG = 64
_U = np.uint64
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 constants), one to one."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two adjoining word sequences from their hashes."""
    return mix(left * _U(0xD6E8FEB86659FD93) + (right ^ _U(0xA0761D6478BD642F)))


class Words:
    """Words of a batch: byte ranges, hashes, and where each text's words begin.

    ``offsets[i]:offsets[i + 1]`` are the words of text ``i``; ``starts`` and
    ``ends`` are byte positions in ``data``, whose texts begin at ``at``.
    """

    def __init__(self, texts: pa.Array, table: np.ndarray, lower: bool):
        raw, at = text_bytes(texts)
        self.at = at
        self.data = LOWER[raw] if lower else raw
        n = len(raw)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = table[self.data]
        first = inside[1:-1] & ~inside[:-2]
        last = inside[1:-1] & ~inside[2:]
        bounds = at[:-1][at[:-1] < at[1:]]  # texts that aren't empty
        first[bounds] = inside[1:-1][bounds]
        ends = at[1:][at[:-1] < at[1:]] - 1
        last[ends] = inside[1:-1][ends]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(self.starts, at)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def texts(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, never 0: eight bytes after eight are mixed in, so that no sum or product of bytes shows through."""
        size = self.ends - self.starts
        out = mix(size.astype(np.uint64) + _U((seed * 0x9E3779B97F4A7C15 + 1) % (1 << 64)))
        padded = np.concatenate((self.data, np.zeros(8, dtype=np.uint8)))
        eight = np.ndarray((len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        rows = np.flatnonzero(size <= _LONG)
        at, left, made = self.starts[rows], size[rows], out[rows]
        while len(rows):
            made = mix(made * _U(0xD6E8FEB86659FD93) + (eight[at] & _BYTES[np.minimum(left, 8)]))
            out[rows] = made
            more = left > 8
            rows, at, left, made = rows[more], at[more] + 8, left[more] - 8, made[more]
        for k in np.flatnonzero(size > _LONG).tolist():
            said = hashlib.blake2b(self.data[self.starts[k] : self.ends[k]].tobytes(), digest_size=8, salt=seed.to_bytes(8))
            out[k] = int.from_bytes(said.digest())
        out[out == 0] = 1
        return out

    def room(self, length: int) -> np.ndarray:
        """Whether ``length`` words of the same text begin at each word."""
        left = np.repeat(self.offsets[1:], self.counts) - np.arange(len(self))
        return left >= length


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, and where each text begins in them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


def trim() -> None:
    """Gives freed memory back to the system: Python workers stay alive, idle, beside later stages."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes of text, one text at least; nothing is left out."""
    _, at = text_bytes(batch.column(column))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield batch.slice(lo, min(hi, n) - lo)
        lo = hi
    trim()


def spans_of(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
