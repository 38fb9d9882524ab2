"""Near-same texts: reduced texts, run sets, MinHash signatures and exact verification.

Texts are compared by their *reduced* form (Unicode letters and digits only) and the set of its
runs of three consecutive characters. Runs are packed into 63-bit integers, three code points of
21 bits each, so that set operations are exact and vectorised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shortest reduced text that takes part, and least share of common runs.
MIN_CHARS, THRESHOLD = 30, 0.6
#: Bands and rows of the MinHash index. At the threshold 0.6 a pair shares a band with probability
#: 1 - (1 - 0.6^4)^32 = 0.988, at 0.67 with 0.999.
BANDS, ROWS = 32, 4
#: Bits of the sketch that pairs must pass before their texts are fetched, and least number of
#: equal bits: 128 * (1 + 0.6) / 2 = 102 are expected at the threshold, standard deviation 4.5.
SKETCH_BITS, SKETCH_LEAST = 128, 85
#: Of the first 32 bits 25.6 are expected to be equal, standard deviation 2.3.
FIRST_LEAST = 18


def reduced(text: Column) -> Column:
    """Letters and digits of the text."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")


def run_arrays(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed runs of all texts one after another, and where each text's runs begin.

    Texts have at least three characters. Runs that span two texts are left out.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    packed = (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]
    ends = np.cumsum(lens)
    keep = np.ones(len(packed), dtype=bool)
    for k in (2, 1):
        at = ends[:-1] - k
        keep[at] = False
    starts = np.concatenate([[0], np.cumsum(lens - 2)[:-1]])
    return packed[keep], starts


def parts(batch: pa.RecordBatch, *texts: int, rows: int = 1000, chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many rows and, but for single rows, so many bytes in the text columns."""
    size = np.zeros(batch.num_rows, dtype=np.int64)
    for i in texts:
        size += np.asarray(pc.fill_null(pc.binary_length(batch.column(i)), 0), dtype=np.int64)
    ends, a = np.cumsum(size), 0
    while a < batch.num_rows:
        z = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 3 * chars, side="right"))
        z = min(max(z, a + 1), a + rows, batch.num_rows)
        yield batch.slice(a, z - a)
        a = z


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(texts: list[str], hashes: int = BANDS * ROWS) -> np.ndarray:
    """MinHash signatures, one row per hash function and one column per text."""
    runs, starts = run_arrays(texts)
    base = (mixed(runs) >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 1 << 31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, hashes, dtype=np.uint32)
    out = np.empty((hashes, len(texts)), dtype=np.uint32)
    for i in range(hashes):
        out[i] = np.minimum.reduceat(base * a[i] + b[i], starts)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per text and band."""
    keys = np.empty((sig.shape[1], BANDS), dtype=np.int64)
    for j in range(BANDS):
        h = np.full(sig.shape[1], 0x9E3779B97F4A7C15 * (j + 1) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for r in range(ROWS):
            h = mixed(h ^ (sig[j * ROWS + r].astype(np.uint64) + np.uint64(r << 32)))
        keys[:, j] = h.view(np.int64)
    return keys


def sketches(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits per text: one mixed bit of each hash function."""
    bits = ((sig * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint64)
    halves = []
    for h in (0, 64):
        word = np.zeros(sig.shape[1], dtype=np.uint64)
        for k in range(64):
            word |= bits[h + k] << np.uint64(k)
        halves.append(word.view(np.int64))
    return halves[0], halves[1]


#: Bits of a map of numbers (8 MB, whatever the size of the tables).
MAP_BITS = 1 << 26


def bit_map(numbers: DataFrame, column: str) -> np.ndarray:
    """Bit map of a column of longs modulo MAP_BITS; MAP_BITS / 64 words at most come to the driver."""
    bit = F.pmod(column, F.lit(MAP_BITS))
    words = numbers.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod({column}, {MAP_BITS}) % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 64, dtype=np.uint64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return out


def held(known: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which numbers the map may hold; the others it surely doesn't."""
    bit = numbers.view(np.uint64) % np.uint64(MAP_BITS)
    return (known[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def shares(left: list[str], right: list[str]) -> np.ndarray:
    """Share of the different runs of both texts that occur in either, for each pair (exact)."""
    number = {t: i for i, t in enumerate(dict.fromkeys([*left, *right]))}
    runs, starts = run_arrays(list(number))
    row = np.repeat(np.arange(len(number)), np.diff(np.append(starts, len(runs))))
    order = np.lexsort((runs, row))
    row, runs = row[order], runs[order]
    new = np.append(True, (np.diff(row) != 0) | (np.diff(runs) != 0))
    row, runs = row[new], runs[new]
    sizes = np.bincount(row, minlength=len(number))
    ends = np.cumsum(sizes)
    a, b = (np.fromiter((number[t] for t in side), dtype=np.int64, count=len(side)) for side in (left, right))
    out = np.empty(len(a))
    for i in range(0, len(a), 2000):
        x, y = a[i : i + 2000], b[i : i + 2000]
        both = np.concatenate([x, y])
        n = sizes[both]
        at = np.repeat(ends[both] - np.cumsum(n), n) + np.arange(n.sum())
        pair = np.repeat(np.concatenate([np.arange(len(x))] * 2), n)
        order = np.lexsort((runs[at], pair))
        p, r = pair[order], runs[at][order]
        common = np.bincount(p[1:][(p[1:] == p[:-1]) & (r[1:] == r[:-1])], minlength=len(x))
        out[i : i + 2000] = common / (sizes[x] + sizes[y] - common)
    return out


def similar(pairs: DataFrame, left: str, right: str, least: float = THRESHOLD) -> DataFrame:
    """Rows of pairs whose two reduced texts share at least that part of their runs (exact)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [batch.schema.get_field_index(c) for c in (left, right)]
            for part in parts(batch, *at, rows=10_000):
                yield part.filter(pa.array(shares(*(part.column(i).to_pylist() for i in at)) >= least))

    return pairs.mapInArrow(check, pairs.schema)


def jaccard(a: str, b: str) -> float:
    """Share of the different runs of both texts that occur in either; equal texts give 1."""
    if a == b:
        return 1.0
    x, y = ({t[i : i + 3] for i in range(len(t) - 2)} for t in (a, b))
    n = len(x & y)
    return n / max(1, len(x) + len(y) - n)
