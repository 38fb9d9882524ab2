"""Near-duplicate texts by MinHash banding (problem 6).

Different texts get numbers in the order of a stored table. The band keys of a block of texts go to
the parts of the key space as packed arrays (a key of 48 bits, the text's place in the block and 32
sketch bits: 12 bytes), so that one shuffle of little more than the keys themselves brings equal keys
together. Pairs of equal keys are enumerated array-wise and must agree in the sketch bits at once; a key that
many texts have is divided into pairs of blocks that other tasks compare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm import near
from lodeweave.session import cut, ship, stored

#: Keys of a part of the key space; texts of a block; texts of one key that a task compares itself, and of a block of larger ones.
PART_KEYS, BLOCK, HOT = 400_000, 1 << 14, 4096
_KEY = np.uint64((1 << 48) - 1)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, text, band keys and sketches of each text; numbers follow each other within a task."""
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        for part in near.parts(batch, 0):
            sig = near.signatures(part.column(0).to_pylist())
            keys, (s0, s1) = near.band_keys(sig).view(np.uint64) & _KEY, near.sketches(sig)
            n, offsets = part.num_rows, np.arange(0, (part.num_rows + 1) * near.BANDS, near.BANDS, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets[: n + 1]), pa.array(keys.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + n)), part.column(0), lists, pa.array(s0), pa.array(s1)], names=["id", "text", "keys", "s0", "s1"])
            number += n


def _blocks(ids: np.ndarray) -> Iterator[slice]:
    """Slices of at most BLOCK rows whose numbers lie within 65,536 of the first."""
    a = 0
    while a < len(ids):
        far = np.flatnonzero((ids[a : a + BLOCK] < ids[a]) | (ids[a : a + BLOCK] - ids[a] > 0xFFFF))
        z = a + (int(far[0]) if len(far) else min(BLOCK, len(ids) - a))
        yield slice(a, z)
        a = z


def _packed(parts: int):
    """Rows of id, keys, s0 to packed entries: part of the key space, first number of the block, entries."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, all_keys = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().view(np.uint64).reshape(-1, near.BANDS)
            all_bits = batch.column(2).to_numpy().view(np.uint32)[::2]
            for rows in _blocks(all_ids):
                ids, keys = all_ids[rows], all_keys[rows].reshape(-1)
                part = (keys % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                place = (ids - ids[0]).astype(np.uint16)[order // near.BANDS]
                bits, keys, part = all_bits[rows][order // near.BANDS], keys[order], part[order]
                edges = np.append(np.flatnonzero(np.append(True, np.diff(part) != 0)), len(part))
                blobs = [place[a:z].tobytes() + bits[a:z].tobytes() + np.ascontiguousarray(keys[a:z]).view(np.uint16).reshape(-1, 4)[:, :3].tobytes() for a, z in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]]), pa.array(np.full(len(blobs), ids[0])), pa.array(blobs, pa.binary())], names=["part", "base", "entries"])

    return packed


def _unpacked(base: int, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(blob) // 12
    wide = np.zeros((n, 4), dtype=np.uint16)
    wide[:, :3] = np.frombuffer(blob, dtype=np.uint16, offset=6 * n).reshape(n, 3)
    return wide.view(np.uint64).reshape(-1), np.frombuffer(blob, dtype=np.uint16, count=n).astype(np.int64) + base, np.frombuffer(blob, dtype=np.uint32, count=n, offset=2 * n)


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 32 - np.bitwise_count(x ^ y) >= near.FIRST_LEAST


def _as_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Different pairs, the smaller number first, with no block."""
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
    none = pa.nulls(len(pairs), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none, none], names=["ia", "ib", "x", "y"])


def _equal_keys(entries: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Pairs of texts with an equal key among the entries of one part of the key space; blocks of the hot keys."""
    keys, ids, bits = (np.concatenate(c) for c in zip(*(_unpacked(*e) for e in entries)))
    order = np.argsort(keys, kind="stable")
    keys, ids, bits = keys[order], ids[order], bits[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    size = np.diff(np.append(first, len(keys)))
    for a, n in zip(first[size > HOT].tolist(), size[size > HOT].tolist()):
        slices = [ids[i : min(i + HOT, a + n)].tobytes() + bits[i : min(i + HOT, a + n)].tobytes() for i in range(a, a + n, HOT)]
        for i, x in enumerate(slices):
            own = slices[i:]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.int64()), pa.array([x] * len(own), pa.binary()), pa.array(own, pa.binary())], names=["ia", "ib", "x", "y"])
    left = np.repeat(size, size)
    alive = np.flatnonzero((left > 1) & (left <= HOT))
    room = np.repeat(first + size, size)  # where each key's entries end
    out, held, step = [], 0, 1
    while len(alive := alive[alive + step < room[alive]]):
        near_ = alive[_alike(bits[alive], bits[alive + step])]
        out.append((ids[near_], ids[near_ + step]))
        held, step = held + len(near_), step + 1
        if held > 2_000_000:
            yield _as_rows(*(np.concatenate(c) for c in zip(*out)))
            out, held = [], 0
    if held:
        yield _as_rows(*(np.concatenate(c) for c in zip(*out)))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, entries = None, []
    for batch in batches:
        for here, base, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if here != part and entries:
                yield from _equal_keys(entries)
                entries = []
            part = here
            entries.append((base, blob))
    if entries:
        yield from _equal_keys(entries)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks of one key that agree in their sketch bits."""
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (ix, bx), (iy, by) = ((np.frombuffer(v, dtype=np.int64, count=len(v) // 12), np.frombuffer(v, dtype=np.uint32, offset=len(v) // 12 * 8)) for v in (x, y))
            for i in range(0, len(ix), 256):
                a, b = np.nonzero(_alike(bx[i : i + 256, None], by[None, :]))
                yield _as_rows(ix[i + a], iy[b]).select(["ia", "ib"])


def classes(texts: DataFrame) -> DataFrame:
    """The different texts of a column text that is reduced; copies are dropped before the shuffle,
    NULLs and texts shorter than near.MIN_CHARS are left out."""
    return texts.select("text").filter(F.length("text") >= near.MIN_CHARS).distinct()


def near_pairs(texts: DataFrame) -> DataFrame:
    """Pairs of different texts that are near-same: a, b (texts, a < b).

    ``texts``: different texts (see classes), each with near.MIN_CHARS characters at least. Candidates must
    agree in enough bits of a sketch (32 bits beside the keys, then all 128) and are then verified on their whole run sets.
    """
    ship(texts.sparkSession)
    known = stored(texts.select("text").mapInArrow(_described, "id long, text string, keys array<long>, s0 long, s1 long"), "texts")
    parts = max(1, -(-known.count() * near.BANDS // PART_KEYS))
    packed = known.select("id", "keys", "s0").mapInArrow(_packed(parts), "part long, base long, entries binary")
    met = packed.repartition("part").sortWithinPartitions("part").mapInArrow(_meet, "ia long, ib long, x binary, y binary")
    met = stored(met, "met")
    hot = met.filter("x is not null").select("x", "y").repartition(F.xxhash64("x", "y")).mapInArrow(_compared, "ia long, ib long")
    pairs = met.filter("x is null").select("ia", "ib").unionByName(hot).repartition("ia").distinct()  # one shuffle serves the distinct and the join on ia
    # stored tables are compressed, so that their size says little: no side is broadcast for it
    sketch = known.select("id", "s0", "s1").hint("merge")
    same = lambda c: F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")))
    close = cut(
        pairs.join(sketch.alias("x"), F.col("ia") == F.col("x.id"))
        .join(sketch.alias("y"), F.col("ib") == F.col("y.id"))
        .filter(near.SKETCH_BITS - same("s0") - same("s1") >= near.SKETCH_LEAST)
        .select("ia", "ib")
    )
    # only texts in a pair are shuffled; a map that fills up lets more of them through
    shared = texts.sparkSession.sparkContext.broadcast(near.bit_map(close.select(F.explode(F.array("ia", "ib")).alias("id")), "id"))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(near.held(shared.value, batch.column(0).to_numpy())))

    wanted = known.select("id", "text").mapInArrow(needed, "id long, text string").hint("merge")
    full = close.join(wanted.select(F.col("id").alias("ia"), F.col("text").alias("ta")), "ia").join(wanted.select(F.col("id").alias("ib"), F.col("text").alias("tb")), "ib")
    return near.similar(full.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")), "a", "b")
