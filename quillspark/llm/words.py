"""Words of whole Arrow string columns as numpy arrays: positions, hashes, shingles and anchors.

Everything here works on one slice of rows at a time (a few MB of text), without a Python loop over
words. Hashes are polynomials over 64-bit integers: prefix sums give the hash of any span at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE, WINDOW_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int, known: dict = {}) -> np.ndarray:  # noqa: B006 (kept from call to call)
    """base ** 0 to base ** (n - 1)."""
    if base not in known or len(known[base]) < n:
        out = np.full(1 << max(10, int(n).bit_length()), base, U)
        out[0] = 1
        known[base] = np.cumprod(out, dtype=U)
    return known[base][:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def byte_class(kind: str) -> np.ndarray:
    """Which bytes belong to words. space: all but space and tab to carriage return; letters: letters, digits and all of non-ASCII; line: all but line feeds."""
    x = np.arange(256)
    if kind == "line":
        return x != 10
    if kind == "space":
        return ~((x == 32) | ((x >= 9) & (x <= 13)))
    return ((x >= 48) & (x <= 57)) | ((x >= 65) & (x <= 90)) | ((x >= 97) & (x <= 122)) | (x >= 128)


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case; other bytes unchanged."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


class Words:
    """Words of a string column; a null counts as an empty text.

    data: the bytes of all rows, offsets: where each row begins; starts, ends: bytes of each word;
    first: the number of words before each row, so row r has the words first[r] to first[r + 1].
    """

    def __init__(self, column: pa.Array, kind: str = "space", lower: bool = False):
        column = column.cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        self.offsets = at - at[0]
        self.data = lowered(raw) if lower else raw
        inside = byte_class(kind)[self.data]
        before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = self.offsets[(self.offsets > 0) & (self.offsets < len(inside))]
        before[edges], after[edges - 1] = False, False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.inside = inside

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each byte span."""
        sums = np.zeros(len(self.data) + 1, U)
        weight = mix(np.arange(1, 257, dtype=U))[self.data]
        np.cumsum(weight * powers(BASE, len(self.data)), out=sums[1:])
        return mix((sums[ends] - sums[starts]) * powers(inverse(BASE), len(sums))[starts] + (ends - starts).astype(U))

    def hashes(self) -> np.ndarray:
        return self.spans(self.starts, self.ends)

    def text(self, word: int) -> bytes:
        return self.data[self.starts[word] : self.ends[word]].tobytes()

    def left(self) -> np.ndarray:
        """For each word, the words of its row from it on."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of so many entries, rows' borders ignored; len(hashes) - length + 1 values."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, U)
    sums = np.zeros(n + 1, U)
    np.cumsum(mix(hashes) * powers(WINDOW_BASE, n), out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * powers(inverse(WINDOW_BASE), n)[: n - length + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def slices(column: pa.Array, most: int = 1 << 18) -> Iterator[pa.Array]:
    """The column in runs of rows with at most so many bytes of text (one row may have more), which fit a CPU's cache."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < len(column):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield column.slice(at, to - at)
        at = to


def spans_of(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of entries; equal to runs() where the lengths are equal."""
    sums = np.zeros(len(hashes) + 1, U)
    np.cumsum(mix(hashes) * powers(WINDOW_BASE, len(hashes)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(inverse(WINDOW_BASE), len(sums))[starts])


def shingles(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), by row, of each row's distinct runs of so many words; a row with fewer words has the whole sequence as its only one."""
    hashes, left = words.hashes(), words.left()
    whole = runs(hashes, length)
    at = np.flatnonzero(left[: len(whole)] >= length)
    few = np.flatnonzero((words.counts > 0) & (words.counts < length))
    rows = np.concatenate([words.rows[at], few])
    found = np.concatenate([whole[at], mix(spans_of(hashes, words.first[few], words.first[few + 1]) + words.counts[few].astype(U))])
    _, index = np.unique(found ^ mix(rows.astype(U) + U(1)), return_index=True)
    index = index[np.argsort(rows[index], kind="stable")]
    return rows[index], found[index]


def joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays([x.cast(kind) if x.type != kind else x for x in parts]) if parts else pa.array([], kind)


def lists(values: np.ndarray | pa.Array, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column with counts[r] of the values in row r."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), values if isinstance(values, pa.Array) else pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == U else x.astype(np.int64)
