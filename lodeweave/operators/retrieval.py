"""Exact nearest neighbours of a stated query set, threshold pairs, weighted votes and retrieval quality.

Queries and library meet in cells, a block of queries and a slice of the library of one tag (the
block column, or one tag for all). Cells come to Python sorted, the queries first; the library
streams by and is compared by matrix products of bounded size. Nothing goes through the driver,
and nothing of the size queries times library is ever held. Only rows of equal tags are compared. The
library is shuffled once for every QUERY_ROWS queries of a tag, the queries once for every slice.
Similarities are rounded to six digits before ranking and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodeweave.functions import vectors as V
from lodeweave.operators import places as P
from lodeweave.session import cut, ship

#: Queries and library rows of a cell, and rows of each side of one matrix product.
QUERY_ROWS, LIBRARY_ROWS, STRIP = 20_000, 100_000, 1000


def _unit(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    m = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _cells(queries: DataFrame, library: DataFrame, vectors: list[str], within: str | None, mark: str | None) -> DataFrame:
    """cell, kind (0 query, 1 library), id, mark and the vectors, sorted within partitions by cell and kind."""
    ship(queries.sparkSession)
    tag = F.lit("") if within is None else F.col(within).cast("string")
    sign = F.lit(None).cast("string") if mark is None else F.col(mark).cast("string")
    whole = F.lit(True)
    for v in vectors:
        whole = whole & F.col(v).isNotNull()
    q, l = (side.select("id", tag.alias("__tag"), sign.alias("mark"), *vectors).filter(whole & F.col("__tag").isNotNull()) for side in (queries, library))
    blocks = q.groupBy("__tag").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("__blocks"))
    grid = blocks.join(l.groupBy("__tag").agg(F.ceil(F.count("*") / LIBRARY_ROWS).alias("__slices")), "__tag")
    pick = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(grid, "__tag").withColumn("__b", pick("__blocks")).withColumn("__s", each("__slices")).withColumn("kind", F.lit(0))
    l = l.join(grid, "__tag").withColumn("__s", pick("__slices")).withColumn("__b", each("__blocks")).withColumn("kind", F.lit(1))
    both = q.unionByName(l).select(F.concat_ws("|", "__b", "__s", "__tag").alias("cell"), "kind", "id", "mark", *vectors)
    return both.repartition("cell").sortWithinPartitions("cell", "kind", "id")


class _Side:
    """Rows of one side: ids, marks and unit vectors."""

    def __init__(self, batches: list[pa.RecordBatch]):
        self.ids = np.concatenate([np.asarray(b.column(2), dtype=np.int64) for b in batches])
        self.marks = np.array([m for b in batches for m in b.column(3).to_pylist()], dtype=object)
        self.vectors = [np.concatenate([_unit(b.column(i)) for b in batches]) for i in range(4, batches[0].num_columns)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Parts of the batches that belong to one cell and kind, of at most STRIP rows."""
    for batch in batches:
        if batch.num_rows:
            cell, kind = np.asarray(batch.column(0).to_pylist(), dtype=object), np.asarray(batch.column(1))
            edges = np.append(np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1]))), batch.num_rows).tolist()
            for a, z in zip(edges[:-1], edges[1:]):
                for i in range(a, z, STRIP):
                    yield cell[a], int(kind[a]), batch.slice(i, min(STRIP, z - i))


def _scanned(start: Callable[[_Side], object], step: Callable, end: Callable):
    """A pass over cells: ``start`` makes the state of a cell's queries, ``step`` takes a part of the
    library and may yield batches, ``end`` yields those of the cell."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, state = None, [], None
        for here, kind, part in _runs(batches):
            if here != cell:
                if state is not None:
                    yield from end(state)
                cell, held, state = here, [], None
            if kind == 0:
                held.append(part)
            elif held or state is not None:
                if state is None:
                    state, held = start(_Side(held)), []
                yield from step(state, _Side([part]))
        if state is not None:
            yield from end(state)

    return scan


class _Nearest:
    """The k nearest library rows so far of a cell's queries."""

    def __init__(self, queries: _Side):
        self.queries = queries
        self.key, self.id = np.zeros((len(queries.ids), 0)), np.zeros((len(queries.ids), 0), dtype=np.int64)


def nearest(queries: DataFrame, library: DataFrame, k: int = 10, within: str | None = None, hardest: bool = False, bonus: float = 0.0, mark: str | None = None) -> DataFrame:
    """query_id, id, sim, rank of the k nearest (or farthest) library rows of each query.

    Both sides: id (long, once per query), embedding, and the column that ``within`` names: then
    only rows of the same value are neighbours. Rows whose ``mark`` column equals the query's get
    the ``bonus`` added. A row is no neighbour of itself (same id). Rows with a NULL vector or a NULL
    block are left out; fewer than k rows give fewer neighbours.
    """
    sign = 1.0 if hardest else -1.0

    def step(state: _Nearest, there: _Side) -> Iterator[pa.RecordBatch]:
        q, keys, ids = state.queries, [], []
        for a in range(0, len(q.ids), STRIP):
            rows = slice(a, a + STRIP)
            sims = np.round(q.vectors[0][rows] @ there.vectors[0].T, 6)
            if bonus:
                sims = sims + bonus * (q.marks[rows, None] == there.marks[None, :])
            key = np.where(q.ids[rows, None] == there.ids[None, :], np.inf, sign * sims)
            key, cand = np.hstack([state.key[rows], key]), np.hstack([state.id[rows], np.broadcast_to(there.ids, key.shape)])
            order = np.lexsort((cand, key), axis=1)[:, :k]
            keys.append(np.take_along_axis(key, order, 1))
            ids.append(np.take_along_axis(cand, order, 1))
        width = min(k, state.key.shape[1] + len(there.ids))
        state.key, state.id = np.concatenate(keys)[:, :width], np.concatenate(ids)[:, :width]
        return iter(())

    def end(state: _Nearest) -> Iterator[pa.RecordBatch]:
        keep = np.isfinite(state.key)
        if keep.any():
            q = np.broadcast_to(state.queries.ids[:, None], state.key.shape)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(state.id[keep]), pa.array(sign * state.key[keep])], names=["query_id", "id", "sim"])

    found = _cells(queries, library, ["embedding"], within, mark if bonus else None).mapInArrow(_scanned(_Nearest, step, end), "query_id long, id long, sim double")
    order = F.asc("sim") if hardest else F.desc("sim")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(order, "id"))).filter(F.col("rank") <= k)


def pairs_where(queries: DataFrame, library: DataFrame, vectors: list[str], test: Callable[[list[np.ndarray]], np.ndarray], within: str | None = None) -> DataFrame:
    """query_id, id and the similarity in each of the vectors of every pair that passes the test.

    ``test`` gets a matrix of similarities for each vector column and gives a mask. All pairs that
    pass are rows; a row and itself are none.
    """

    def step(q: _Side, there: _Side) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(q.ids), STRIP):
            rows = slice(a, a + STRIP)
            sims = [np.round(x[rows] @ y.T, 6) for x, y in zip(q.vectors, there.vectors)]
            i, j = np.nonzero(test(sims) & (q.ids[rows, None] != there.ids[None, :]))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(q.ids[rows][i]), pa.array(there.ids[j]), *(pa.array(s[i, j]) for s in sims)], names=["query_id", "id", *vectors])

    schema = ", ".join(["query_id long", "id long", *(f"{v} double" for v in vectors)])
    return _cells(queries, library, vectors, within, None).mapInArrow(_scanned(lambda q: q, step, lambda q: iter(())), schema)


def kernel_sums(queries: DataFrame, library: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """query_id, total: the sum of a function of the similarity with every other library row."""

    def start(q: _Side) -> list:
        return [q, np.zeros(len(q.ids))]

    def step(state: list, there: _Side) -> Iterator[pa.RecordBatch]:
        q = state[0]
        for a in range(0, len(q.ids), STRIP):
            rows = slice(a, a + STRIP)
            values = np.where(q.ids[rows, None] == there.ids[None, :], 0.0, kernel(q.vectors[0][rows] @ there.vectors[0].T))
            state[1][rows] += values.sum(axis=1)
        return iter(())

    def end(state: list) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(state[0].ids), pa.array(state[1])], names=["query_id", "total"])

    parts = _cells(queries, library, ["embedding"], None, None).mapInArrow(_scanned(start, step, end), "query_id long, total double")
    return parts.groupBy("query_id").agg(F.sum("total").alias("total"))


def tagged(rows: DataFrame, *levels: list) -> DataFrame:
    """The rows once for each level, a list of columns, with a tag that names the level and its values."""
    tags = F.array(*[F.concat_ws("/", F.lit(str(i)), *[F.col(c).cast("string") for c in level]) for i, level in enumerate(levels)])
    return rows.withColumn("tag", F.explode(tags))


def first_level(queries: DataFrame, library: DataFrame, least: int, *levels: list) -> DataFrame:
    """The queries with the tag of the first level in which ``least`` library rows other than themselves
    share it, else of the last. The number of rows of each tag is counted, not the rows joined."""
    sizes = tagged(library, *levels).groupBy("tag").agg(F.count("*").alias("size"))
    own = tagged(library, *levels).select("id", "tag", F.lit(1).alias("own"))
    each = tagged(queries, *levels).join(sizes, "tag", "left").join(own, ["id", "tag"], "left").withColumn("level", F.split_part("tag", F.lit("/"), F.lit(1)).cast("int"))
    fits = (F.coalesce("size", F.lit(0)) - F.coalesce("own", F.lit(0)) >= least) | (F.col("level") == len(levels) - 1)
    chosen = each.filter(fits).groupBy("id").agg(F.min(F.struct("level", "tag", (F.coalesce("size", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("candidates"))).alias("t"))
    return queries.join(chosen.select("id", "t.level", "t.tag", "t.candidates"), "id")


def nearest_with_fallback(queries: DataFrame, library: DataFrame, block: str, k: int = 10, least: int = 3) -> DataFrame:
    """Neighbours within the query's block; where the block has fewer than ``least`` rows, of all rows."""
    sizes = library.filter("embedding is not null").groupBy(block).agg(F.count("*").alias("__size"))
    tag = F.when(F.coalesce("__size", F.lit(0)) >= least, F.concat_ws("/", F.lit("0"), F.col(block).cast("string"))).otherwise("1")
    asked = queries.join(sizes, block, "left").withColumn("tag", tag)
    return nearest(asked, tagged(library, [block], []), k, within="tag")


def vote(neighbours: DataFrame, facts: DataFrame, floor: float = 0.0) -> DataFrame:
    """Vote of each query: sum of c * max(sim, 0) * y over the sum of the weights. ``facts``: id, y, c."""
    w = F.greatest(F.col("c"), F.lit(floor)) * F.greatest(F.col("sim"), F.lit(0.0))
    return neighbours.join(facts.select("id", "y", "c"), "id").groupBy("query_id").agg((F.sum(w * F.col("y")) / (F.sum(w) + 1e-8)).alias("vote"), F.count("*").alias("n"))


def retrieval_quality(neighbours: DataFrame, facts: DataFrame) -> DataFrame:
    """Share of neighbours with the query's label, and mean average precision by attribute. ``facts``: id, y, attr."""
    q = facts.select(F.col("id").alias("query_id"), F.col("y").alias("qy"), F.col("attr").alias("qa"))
    rows = neighbours.join(facts.select("id", "y", "attr"), "id").join(q, "query_id").withColumn("rel", (F.col("attr") == F.col("qa")).cast("int"))
    cum = F.sum("rel").over(W.partitionBy("query_id").orderBy("rank")) / F.col("rank")
    per = rows.withColumn("prec", cum).groupBy("query_id").agg(F.avg((F.col("y") == F.col("qy")).cast("double")).alias("match"), F.coalesce(F.sum(F.col("prec") * F.col("rel")) / F.nullif(F.sum("rel"), F.lit(0)), F.lit(0.0)).alias("ap"))
    return per.agg(F.avg("match").alias("label_match"), F.avg("ap").alias("attr_map"), F.count("*").alias("n"))


def contrast_value(neighbours: DataFrame, facts: DataFrame, tau: float = 0.1) -> DataFrame:
    """Contrastive loss value of each query over its neighbours: -log of the positives' share of exp(sim / tau)."""
    q = facts.select(F.col("id").alias("query_id"), F.col("y").alias("qy"))
    e = F.exp(F.col("sim") / tau)
    rows = neighbours.join(facts.select("id", "y"), "id").join(q, "query_id")
    sums = rows.groupBy("query_id").agg(F.sum(F.when(F.col("y") == F.col("qy"), e)).alias("a"), F.sum(e).alias("b"))
    return sums.filter("a is not null").select("query_id", (-F.log(F.col("a") / F.col("b"))).alias("loss"))


def prototypes(rows: DataFrame, by: str, weight: str = "c") -> DataFrame:
    """Weighted mean vector of each group, of unit length, in long form: group, pos, value."""
    long = rows.select(by, F.col(weight).cast("double").alias("w"), F.posexplode("embedding").alias("pos", "v"))
    mean = long.groupBy(by, "pos").agg((F.sum(F.col("w") * F.col("v").cast("double")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    return mean.withColumn("value", F.col("m") / F.sqrt(F.sum(F.col("m") * F.col("m")).over(W.partitionBy(by)))).drop("m")


def prototype_loss(queries: DataFrame, library: DataFrame, group: str, least: int = 3, c_min: float = 0.0, tau: float = 0.1) -> DataFrame:
    """M5: query_id, level, loss: cross entropy of a query's similarities to the two prototypes of its group,
    times its weight; level 0 is the group, 1 all rows where the group lacks ``least`` rows of a label.

    Both: id, embedding, y (0 or 1), c and the group. Prototypes are unit means of unit vectors weighted
    by c. Rows below ``c_min`` or with a NULL vector are left out, as are queries without both prototypes.
    """
    unit = lambda v: V.scaled(v, 1 / F.nullif(V.norm(v), F.lit(0.0)))
    fit = lambda rows: rows.filter((F.col("c") >= c_min) & F.col("embedding").isNotNull()).withColumn("u", unit(F.col("embedding")))
    rows = tagged(fit(library), [group], []).select("tag", "y", "c", "u")
    counts = rows.groupBy("tag").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    long = rows.select("tag", "y", F.col("c").cast("double").alias("w"), F.posexplode("u").alias("pos", "x"))
    means = long.groupBy("tag", "y", "pos").agg(F.sum(F.col("w") * F.col("x")).alias("m"))
    protos = means.groupBy("tag", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias("v"))
    both = protos.groupBy("tag").agg(F.max(F.when(F.col("y") == 1, F.col("v"))).alias("vp"), F.max(F.when(F.col("y") == 0, F.col("v"))).alias("vn")).join(counts, "tag")
    asked = tagged(fit(queries), [group], []).select(F.col("id").alias("query_id"), "y", "c", "u", "tag", F.split_part("tag", F.lit("/"), F.lit(1)).cast("int").alias("level"))
    met = asked.join(both, "tag").filter((F.col("level") == 1) | ((F.col("pos") >= least) & (F.col("neg") >= least)))
    sp, sn = V.dot(F.col("u"), unit(F.col("vp"))) / tau, V.dot(F.col("u"), unit(F.col("vn"))) / tau
    own = F.when(F.col("y") == 1, sp).otherwise(sn)
    value = F.col("c") * (F.greatest(sp, sn) + F.log(F.exp(sp - F.greatest(sp, sn)) + F.exp(sn - F.greatest(sp, sn))) - own)
    each = met.filter("vp is not null and vn is not null").select("query_id", F.struct("level", value.alias("loss")).alias("z"))
    return each.groupBy("query_id").agg(F.min_by("z", F.col("z.level")).alias("z")).select("query_id", "z.level", "z.loss")


def geometry(queries: DataFrame, library: DataFrame) -> DataFrame:
    """One row of geometry measures of labelled queries among themselves and against a labelled library.

    Both: id, embedding, y (0 or 1). Among the queries: mean squared distance of pairs of the same label
    (alignment; of label 1 alone), log mean exp(-2 d^2) of all pairs (uniformity), silhouette by cosine. Against the
    library: purity of the 1, 5, 10, 20 nearest, accuracy and F1 of the vote of ten (a tie counts as 0), the
    margin between the nearest of the same and of the other label, and margin and purity of the hardest
    quarter. Sums over pairs of one label come from the sums of their vectors. Undefined measures are NULL.
    """
    unit = queries.filter("embedding is not null").select("id", "y", V.scaled(F.col("embedding"), 1 / F.nullif(V.norm(F.col("embedding")), F.lit(0.0))).alias("v"))
    long = unit.select("y", F.posexplode("v").alias("pos", "x")).groupBy("y", "pos").agg(F.sum("x").alias("s"))
    sums = long.groupBy("y").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda e: e["s"]).alias("s"))  # a row per label
    sizes = unit.groupBy("y").agg(F.count("*").alias("n"))
    label = sums.join(sizes, "y").withColumn("inside", (V.dot(F.col("s"), F.col("s")) - F.col("n")) / 2).withColumn("pairs", F.col("n") * (F.col("n") - 1) / 2)
    safe = lambda a, b: a / F.nullif(b, F.lit(0))
    aligned = label.agg(safe(F.sum(2 * F.col("pairs") - 2 * F.col("inside")), F.sum("pairs")).alias("alignment"), safe(F.sum(F.when(F.col("y") == 1, 2 * F.col("pairs") - 2 * F.col("inside"))), F.sum(F.when(F.col("y") == 1, F.col("pairs")))).alias("alignment_pos"))
    # silhouette: mean cosine distance to a label from the sum of its vectors
    to = unit.join(F.broadcast(label.select(F.col("y").alias("ly"), "s", "n"))).withColumn("d", F.when(F.col("y") == F.col("ly"), safe(F.col("n") - V.dot(F.col("v"), F.col("s")), F.col("n") - 1)).otherwise(1 - V.dot(F.col("v"), F.col("s")) / F.col("n")))
    per = to.groupBy("id").agg(F.max(F.when(F.col("y") == F.col("ly"), F.col("d"))).alias("a"), F.min(F.when(F.col("y") != F.col("ly"), F.col("d"))).alias("b"), F.max(F.when(F.col("y") == F.col("ly"), F.col("n"))).alias("m"))
    sil = per.agg(F.avg(F.when(F.col("m") == 1, 0.0).otherwise(safe(F.col("b") - F.col("a"), F.greatest("a", "b")))).alias("silhouette"))
    uniform = kernel_sums(queries, queries, lambda s: np.exp(-4.0 + 4.0 * s)).agg(F.sum("total").alias("t"), F.count("*").alias("n")).select(F.log(safe(F.col("t"), F.col("n") * (F.col("n") - 1))).alias("uniformity"))
    labels = library.select("id", F.col("y").alias("ly"))
    asked = queries.select(F.col("id").alias("query_id"), "y")
    rows = nearest(queries, library, 20).join(labels, "id").join(asked, "query_id").withColumn("hit", (F.col("ly") == F.col("y")).cast("double"))
    upto = lambda k: F.avg(F.when(F.col("rank") <= k, F.col("hit"))).alias(f"purity_{k}")
    near = rows.groupBy("query_id", "y").agg(*map(upto, (1, 5, 10, 20)), (F.avg(F.when(F.col("rank") <= 10, F.col("ly").cast("double"))) > 0.5).cast("int").alias("vote"))
    best = lambda tag, name: nearest(queries.withColumn("tag", tag), library.withColumn("tag", F.col("y")), 1, within="tag").select("query_id", F.col("sim").alias(name))
    judged = cut(near.join(best(F.col("y"), "same"), "query_id", "left").join(best(1 - F.col("y"), "other"), "query_id", "left").withColumn("other", F.coalesce("other", F.lit(-2.0))).withColumn("margin", F.coalesce("same", F.lit(-2.0)) - F.col("other")))
    limit = P.quantiles(judged, "other", [0.75]).select(F.col("cut")[0].alias("hard"))
    hard = F.col("other") >= F.col("hard") - 1e-12
    tp, fp, fn = (F.sum(F.when((F.col("vote") == v) & (F.col("y") == y), 1.0).otherwise(0.0)) for v, y in ((1, 1), (1, 0), (0, 1)))
    told = judged.join(F.broadcast(limit)).agg(
        *[F.avg(f"purity_{k}").alias(f"purity_{k}") for k in (1, 5, 10, 20)], F.avg((F.col("vote") == F.col("y")).cast("double")).alias("knn_acc"), F.coalesce(safe(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("knn_f1"),
        F.avg("margin").alias("margin"), F.avg((F.col("margin") > 0).cast("double")).alias("margin_pos"), F.avg(F.when(hard, F.col("margin"))).alias("hard_margin"), F.avg(F.when(hard, F.col("purity_10"))).alias("hard_purity"), F.count("*").alias("n"),
    )
    return told.join(F.broadcast(aligned)).join(F.broadcast(sil)).join(F.broadcast(uniform))
