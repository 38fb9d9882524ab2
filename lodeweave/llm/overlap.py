"""Overlaps between evaluation and training texts by Aho-Corasick automata (problem 5).

Every evaluation text is divided into segments, two more than a text can have been damaged in
places while it still shares the part THRESHOLD of its runs, if a place of damage costs at least
3.8 runs (an inserted character takes two runs away and adds three; 2 + 0.6 * 3). Segments have
LEAST characters or more. A training text that holds one whole segment is compared with the text.

Segments are sharded by their anchor, the run of GRAM characters of the least hash in the segment.
A training text goes to the shards of those anchors that it holds itself, with the surroundings of
these places only, so that the work for a text is bounded by its anchors however many shards there
are. Anchors that no evaluation text has are left out by a bit map of fixed size; where it fills up,
texts meet more shards, but none is lost. Cells of a shard with bounded numbers of rows split a shard whose anchors are hot
on either side. Cells come to Python sorted, evaluation rows first: the automaton of the cell's
segments is built once and scans the training texts as they stream by.

Pairs that meet in a cell pass two exact bounds: the numbers of different runs, and the common bits
of two bit sets of runs with the runs that share a bit. The few that are left are compared on their
whole texts. The matched segments of a pair are its intervals; ``merged`` unites those of all
training texts into the coverage of an evaluation text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm import near
from lodeweave.session import cut, ship

#: Characters of segments in a shard; its automaton takes about 60 bytes for each.
SHARD_CHARS = 1_000_000
#: Most shards of a field, so that the table of cells has a bound and may be broadcast; beyond it shards have more cells.
MOST_SHARDS = 1 << 16
#: Training and evaluation texts of a cell; a shard with more has several cells.
TRAIN_ROWS, EVAL_ROWS = 20_000, 200_000
#: Characters of an anchor, of the shortest and of the longest segment; in any SHORT - GRAM + 1 = 3 runs in a row one is the least.
GRAM, SHORT, LONG = 5, 7, 12
#: Texts scanned together, candidate pairs weighed together, 64-bit words of a bit set of runs.
TEXTS, PAIRS_AT_ONCE, WORDS = 2000, 2_000_000, 8
PAIRS = "field_name string, train_key string, eval_key string, coverage double, similarity double, eval_chars int, spans array<struct<a:int,z:int>>"
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def n_segments(n: int) -> int:
    """Segments of a text of n characters: more than the places of damage that it can have."""
    return min(int((1 - near.THRESHOLD) * (n - 2) / 3.8) + 2, n // SHORT)


def segments(text: str) -> list[tuple[int, int]]:
    """Bounds of the segments of a reduced text."""
    k = n_segments(len(text))
    return [(len(text) * i // k, len(text) * (i + 1) // k) for i in range(k)]


def different_runs(text: str) -> int:
    """Number of different runs; a pair's similarity is at most the smaller number over the larger."""
    return len({text[i : i + 3] for i in range(len(text) - 2)})


def coverage(intervals: list[tuple[int, int]], length: int) -> float:
    """Part of a text that the union of the intervals covers."""
    total = last = 0
    for a, z in sorted(intervals):
        total += max(0, z - max(a, last))
        last = max(last, z)
    return total / max(1, length)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of GRAM characters at each place of all texts one after another (the
    greatest number where a run would leave its text), and where each text begins."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lens)
    codes = np.concatenate([codes, np.zeros(GRAM, dtype=np.uint64)])
    n = int(ends[-1])
    head = (codes[:n] << np.uint64(42)) | (codes[1 : n + 1] << np.uint64(21)) | codes[2 : n + 2]
    tail = (codes[3 : n + 3] << np.uint64(21)) | codes[4 : n + 4]
    h = near.mixed(head ^ near.mixed(tail + np.uint64(0x9E3779B97F4A7C15)))
    for k in range(1, GRAM):
        h[ends - k] = _NONE
    return h, ends - lens


def segment_anchors(texts: list[str]) -> list[np.ndarray]:
    """Anchor of each segment of each text."""
    h, starts = _grams(texts)
    h = np.append(h, _NONE)
    bounds = [segments(t) for t in texts]
    edges = np.fromiter((x for s, b in zip(starts.tolist(), bounds) for a, z in b for x in (s + a, s + z - GRAM + 1)), dtype=np.int64)
    least = np.minimum.reduceat(h, edges)[::2].view(np.int64)
    return np.split(least, np.cumsum([len(b) for b in bounds])[:-1])


def text_anchors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and hash of every run that can be the anchor of a segment: the least of three in a row."""
    h, starts = _grams(texts)
    padded = np.concatenate([np.full(2, _NONE), h, np.full(2, _NONE)])
    least = np.minimum(np.minimum(padded[:-2], padded[1:-1]), padded[2:])
    at = np.flatnonzero((h != _NONE) & ((h == least[:-2]) | (h == least[1:-1]) | (h == least[2:])))
    row = np.searchsorted(starts, at, side="right") - 1
    return row, at - starts[row], h[at].view(np.int64)


def run_bits(texts: list[str]) -> np.ndarray:
    """A bit set of the runs of each text: WORDS words of 64 bits."""
    out = np.zeros((len(texts), WORDS), dtype=np.uint64)
    for i in range(0, len(texts), 5000):
        part = texts[i : i + 5000]
        runs, starts = near.run_arrays(part)
        rows = np.repeat(np.arange(len(part)), np.diff(np.append(starts, len(runs))))
        flags = np.zeros((len(part), WORDS * 64), dtype=bool)
        flags[rows, (near.mixed(runs) % np.uint64(WORDS * 64)).astype(np.int64)] = True
        out[i : i + 5000] = np.packbits(flags, axis=1).view(np.uint64)
    return out


def _count(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=1, dtype=np.int64)


class Shard:
    """Automaton of the segments of some evaluation texts: rows of id, number of different runs, bit set and segments."""

    def __init__(self, rows: list[tuple[int, int, bytes, list[str]]]):
        import ahocorasick

        self.ids = np.array([r[0] for r in rows], dtype=np.int64)
        self.sizes = np.array([r[1] for r in rows], dtype=np.int64)
        self.bits = _bits([r[2] for r in rows])
        self.shared = self.sizes - _count(self.bits)
        owners: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            for word in set(r[3]):
                owners.setdefault(word, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for n, word in enumerate(owners):
            self.automaton.add_word(word, n)
        self.automaton.make_automaton()
        self.counts = np.fromiter(map(len, owners.values()), dtype=np.int64, count=len(owners))
        self.starts = np.cumsum(self.counts) - self.counts
        self.owners = np.fromiter((i for o in owners.values() for i in o), dtype=np.int64)

    def _met(self, row: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Different pairs of a row and an evaluation text that share a segment, in parts of bounded size."""
        n = self.counts[word]
        part = np.cumsum(n) // PAIRS_AT_ONCE
        for k in np.unique(part):
            r, w, m = row[part == k], word[part == k], n[part == k]
            at = np.repeat(self.starts[w] - np.cumsum(m) + m, m) + np.arange(m.sum())
            yield np.divmod(np.unique(np.repeat(r, m) * len(self.ids) + self.owners[at]), len(self.ids))

    def pairs(self, rows: list[tuple[int, int, bytes, str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of training and evaluation texts that share a segment and may be near-same. rows: id, number of different runs, bit set, text."""
        row, word = [], []
        for i, r in enumerate(rows):
            found = {n for _, n in self.automaton.iter(r[3])}
            word += found
            row += [i] * len(found)
        if not row:
            return
        ids, sizes, bits = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64), _bits([r[2] for r in rows])
        shared = sizes - _count(bits)
        for i, e in self._met(np.array(row, dtype=np.int64), np.array(word, dtype=np.int64)):
            x, y = sizes[i], self.sizes[e]
            fits = np.minimum(x, y) >= near.THRESHOLD * np.maximum(x, y) - 1e-9
            i, e, least = i[fits], e[fits], (near.THRESHOLD / (1 + near.THRESHOLD) * (x + y))[fits]
            most = _count(bits[i] & self.bits[e]) + np.minimum(shared[i], self.shared[e])
            yield ids[i[most >= least - 1e-9]], self.ids[e[most >= least - 1e-9]]


def _bits(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.uint64).reshape(-1, WORDS)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from near.parts(batch, 2, rows=TEXTS)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, field_name, text with the number of different runs and their bit set."""
    for part in _parts(batches):
        texts = part.column(2).to_pylist()
        n, bits = pa.array(map(different_runs, texts), pa.int32()), pa.array([b.tobytes() for b in run_bits(texts)], pa.binary())
        yield pa.RecordBatch.from_arrays([*part.columns, n, bits], names=["id", "field_name", "text", "n_runs", "bits"])


def _eval_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        texts = part.column(2).to_pylist()
        words = [[t[a:z] for a, z in segments(t)] for t in texts]
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(segment_anchors(texts), pa.list_(pa.int64())), pa.array(words, pa.list_(pa.string()))], names=["id", "field_name", "text", "n_runs", "bits", "anchors", "words"])


def _visits(shared, sizes: dict[str, int], texts: bool):
    """Shards that training texts meet: field, shard and, if asked, id, n_runs, bits and the text around the anchors."""

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in _parts(batches):
            whole, fields = part.column(2).to_pylist(), part.column(1).to_pylist()
            row, place, anchor = text_anchors(whole)
            held = near.held(known, anchor)
            row, place = row[held], place[held]
            shard = anchor[held] % np.array([sizes.get(f, 1) for f in fields], dtype=np.int64)[row]
            order = np.lexsort((place, shard, row))
            row, place, shard = row[order], place[order], shard[order]
            first = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(shard) != 0))) if len(row) else np.zeros(0, dtype=np.int64)
            take = pa.array(row[first])
            columns, names = [part.column(1).take(take), pa.array(shard[first], pa.int64())], ["field_name", "shard"]
            if texts:
                near_by = [_around(whole[r], p.tolist()) for r, p in zip(row[first].tolist(), np.split(place, first[1:]))]
                columns += [part.column(0).take(take), part.column(3).take(take), part.column(4).take(take), pa.array(near_by, pa.string())]
                names += ["id", "n_runs", "bits", "text"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return visits


def _around(text: str, places: list[int]) -> str:
    """The surroundings of the places, where they are shorter than the text."""
    side = LONG - GRAM
    if len(places) * (LONG + side + 1) >= len(text):
        return text
    return " ".join(text[max(0, p - side) : p + LONG] for p in places)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells in a row: cell, kind (0 evaluation, 1 training), id, n_runs, bits, words, text."""
    cell, known, texts, shard = None, [], [], None
    as_batch = lambda p: pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], names=["train_id", "eval_id"])
    for batch in batches:
        for here, kind, number, n, bits, words, text in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if here != cell:
                if texts:
                    yield from map(as_batch, shard.pairs(texts))
                cell, known, texts, shard = here, [], [], None
            if kind == 0:
                known.append((number, n, bits, words))
            elif known:
                shard = shard or Shard(known)
                texts.append((number, n, bits, text))
                if len(texts) == TEXTS:
                    yield from map(as_batch, shard.pairs(texts))
                    texts = []
    if texts:
        yield from map(as_batch, shard.pairs(texts))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole texts are near-same, with their matched intervals: field_name, training text, evaluation text."""
    kinds = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())])))
    for part in _parts(batches):
        rows = []
        for field, here, there in zip(*(part.column(i).to_pylist() for i in range(3))):
            if (s := near.jaccard(here, there)) >= near.THRESHOLD:
                met = [(a, z) for a, z in segments(there) if there[a:z] in here]
                rows.append((field, _key(here), _key(there), coverage(met, len(there)), s, len(there), [{"a": a, "z": z} for a, z in met]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in PAIRS.split(", ")])


def _key(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


_DESCRIBED = "id long, field_name string, text string, n_runs int, bits binary"


def text_key(text: Column) -> Column:
    """128-bit key of a text."""
    return F.md5(text)


def overlaps(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Near-same pairs of different texts' keys: field_name, train_key, eval_key, coverage,
    similarity, and the length and the matched intervals of the evaluation text.

    Both sides: field_name, text (reduced; repeats allowed). NULLs and texts shorter than
    near.MIN_CHARS are left out. A text that both sides have is a pair with itself. Empty sides give no rows.
    """
    ship(train.sparkSession)
    whole = (F.length("text") >= near.MIN_CHARS) & F.col("field_name").isNotNull()
    described = lambda side: side.select("field_name", "text").filter(whole).distinct().select(F.xxhash64("field_name", "text").alias("id"), "field_name", "text").mapInArrow(_described, _DESCRIBED)
    known = cut(described(evaluation).mapInArrow(_eval_anchors, f"{_DESCRIBED}, anchors array<long>, words array<string>"))
    texts = cut(described(train))
    # one row of sizes per field comes to the driver
    sizes = {r[0]: min(MOST_SHARDS, max(1, -(-r[1] // SHARD_CHARS))) for r in known.groupBy("field_name").agg(F.sum(F.length("text"))).collect()}
    shards = F.coalesce(*[F.when(F.col("field_name") == f, F.lit(n)) for f, n in sizes.items()], F.lit(1))
    shared = train.sparkSession.sparkContext.broadcast(near.bit_map(known.select(F.explode("anchors").alias("anchor")), "anchor"))
    of = known.select("id", "field_name", "n_runs", "bits", "words", F.transform("anchors", lambda a: F.pmod(a, shards)).alias("of"))
    parts = of.select("*", F.explode(F.array_distinct("of")).alias("shard")).withColumn("words", F.expr("filter(words, (w, i) -> of[i] = shard)")).drop("of")
    # cells of each shard: a grid over its training and evaluation texts
    grid = texts.mapInArrow(_visits(shared, sizes, False), "field_name string, shard long").groupBy("field_name", "shard").agg(F.ceil(F.count("*") / TRAIN_ROWS).alias("slices"))
    grid = F.broadcast(cut(grid.join(parts.groupBy("field_name", "shard").agg(F.ceil(F.count("*") / EVAL_ROWS).alias("blocks")), ["field_name", "shard"])))
    cell = [F.concat_ws("-", "field_name", "shard", "slice", "block").alias("cell"), "kind", "id", "n_runs", "bits", "words", "text"]
    there = parts.join(grid, ["field_name", "shard"]).withColumn("block", F.pmod("id", "blocks")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    there = there.withColumns({"kind": F.lit(0), "text": F.lit(None).cast("string")})
    here = texts.mapInArrow(_visits(shared, sizes, True), "field_name string, shard long, id long, n_runs int, bits binary, text string").join(grid, ["field_name", "shard"])
    here = here.withColumn("slice", F.pmod("id", "slices")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"kind": F.lit(1), "words": F.lit(None).cast("array<string>")})
    met = there.select(*cell).unionByName(here.select(*cell)).repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(_scan, "train_id long, eval_id long").distinct()
    full = met.join(texts.select(F.col("id").alias("train_id"), "field_name", F.col("text").alias("here")), "train_id").join(known.select(F.col("id").alias("eval_id"), "field_name", F.col("text").alias("there")), ["eval_id", "field_name"])
    return full.select("field_name", "here", "there").mapInArrow(_verified, PAIRS)


def merged(pairs: DataFrame) -> DataFrame:
    """eval_id, field_name, eval_key, coverage: the part of each evaluation text that the united
    intervals of all its training texts cover. Segments of a text don't overlap, so that different
    ones add up. ``pairs``: eval_id, field_name, eval_key, eval_chars, spans."""
    spans = pairs.select("eval_id", "field_name", "eval_key", "eval_chars", F.explode("spans").alias("s")).distinct()
    return spans.groupBy("eval_id", "field_name", "eval_key").agg((F.sum(F.col("s.z") - F.col("s.a")) / F.max("eval_chars")).alias("coverage"))
