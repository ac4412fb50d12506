"""Words and word shingles of Arrow string batches as 64-bit hashes, with numpy inside the tasks.

A batch's UTF-8 bytes are one buffer; words are runs of word bytes in it that don't cross a text's end. The hash of a
word is a polynomial of its bytes modulo 2^64 (from prefix sums) that is mixed afterwards, so that equal words have
equal hashes anywhere and different words differ but for chance of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 19
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)  # odd
BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


_cache: dict[str, np.ndarray] = {}


def _table(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_cache.get(name, ())) < n:
        _cache[name] = _powers(base, max(n, CHUNK_BYTES + 2))
    return _cache[name]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words between spaces and control white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of digits, ASCII letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64 bits without visible structure."""
    x = x ^ U((seed * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _piece(data: np.ndarray, edges: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of data, which don't cross the edges."""
    n, low = len(data), LOWER[data]
    inside = kind[low]
    edge = np.zeros(n + 1, dtype=bool)
    edge[edges] = edge[0] = edge[n] = True
    start = np.flatnonzero(inside & (edge[:n] | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    sums = np.zeros(n + 1, dtype=U)
    np.cumsum((low.astype(U) + U(1)) * _table("up", BASE, n + 1)[:n], out=sums[1:])
    return start, end, mix((sums[end] - sums[start]) * _table("down", BASE_INV, n + 1)[start] + (end - start).astype(U))


class Words:
    """Words of some texts: start and end (bytes in buffer), hash, and first[i]:first[i + 1] for the i-th text.

    The buffer is gone through in pieces of about CHUNK_BYTES that end between words, so that a very long text takes
    memory for its words and not some forty bytes for each of its own.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        self.data = data
        starts, ends, hashes = [], [], []
        at, edges = 0, np.unique(offsets)
        while at < len(data):
            to = min(len(data), at + CHUNK_BYTES)
            while to < len(data):  # to the end of the word that is open here
                gap = np.flatnonzero(~kind[data[to : to + CHUNK_BYTES]])
                if len(gap):
                    to += int(gap[0])
                    break
                to = min(len(data), to + CHUNK_BYTES)
            own = edges[np.searchsorted(edges, at) : np.searchsorted(edges, to, side="right")] - at
            start, end, h = _piece(data[at:to], own, kind)
            starts.append(start + at)
            ends.append(end + at)
            hashes.append(h)
            at = to
        none = np.zeros(0, np.int64)
        self.start, self.end = np.concatenate([none, *starts]), np.concatenate([none, *ends])
        self.hash = np.concatenate([np.zeros(0, U), *hashes])
        self.first = np.searchsorted(self.start, offsets)

    def prefix(self, size: int, words: slice = slice(None)) -> np.ndarray:
        """Hash of each word's first size bytes; 0 for words that are not longer."""
        start = self.start[words]
        long = start + size < self.end[words]
        out, s, h = np.zeros(len(start), dtype=U), start[long], np.zeros(int(long.sum()), dtype=U)
        for i in range(size):
            h = h * BASE + LOWER[self.data[s + i]] + U(1)
        out[long] = mix(h, size)
        return out

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on, whatever text they belong to; valid where starts() says so."""
        n = max(0, len(self.hash) - k + 1)
        out = np.zeros(n, dtype=U)
        for i in range(k):
            out = out * BASE + self.hash[i : i + n]
        return mix(out, k)

    def sets(self, k: int) -> Iterator[np.ndarray]:
        """Sorted distinct k-gram hashes of each text; with fewer words, the whole sequence's hash; empty without."""
        grams = self.grams(k)
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                h = U(0)
                with np.errstate(over="ignore"):
                    for x in self.hash[a:b]:
                        h = h * BASE + x
                yield mix(np.array([h]), 1000 + b - a)
            else:
                yield grams[:0]


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets within) of runs of texts; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        b = min(b, n)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(column, kind: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    for a, b, data, offsets in chunks(column):
        yield a, b, Words(data, offsets, kind)
