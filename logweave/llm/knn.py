"""Exact top-k search by inner product as a Voronoi join.

1. Components become ``floor(scale * x)``. ``PIVOTS`` vectors of a bounded sample cut the space into
   cells; every data row goes to its nearest pivot's cell, every query to a group the same way.
2. Summaries, of bounded size: per cell its radius, the largest norm and the ``k + 1``
   distinct ids nearest to the pivot; per group its radius and largest norm.
3. Bounds. For a query ``q = c + d`` of a group around ``c`` and a row ``x = p + e`` of a cell around ``p``,
   ``q.x`` differs from ``c.p`` by at most ``|d||p| + |q||e|``. The near ids of all cells, each
   counted once, give every group a score that its queries' k-th results reach; cells whose upper bound is below
   it are not sent to the group.
4. Cells and groups travel as blocks of at most ``BLOCK`` rows, whatever their size, so that a vector
   shared by a third of all rows is many blocks. Each pair of blocks that the bounds leave is solved
   by a matrix product, with running results per query; one ranking per query follows.

Ties go to the smaller id. Nulls and edges: vectors that are null, empty or hold null or non-finite
components take no part, nor do rows with a null id; vectors are compared with those of their own
length; repeated data rows are rows of their own; queries that share an id are one, ranked by the best
results of all its vectors; a query never finds a row with its own id. Inner products must fit 63 bits.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from logweave.session import materialize

PIVOTS = 64
BLOCK = 2048
QUERY_BLOCK = 512
LOWEST = -(2**63) + 1


def quantised(df, vector="embedding", key="vec_id", scale=64):
    """``id, v``: whole-number components of the vectors that take part."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return df.where(F.col(key).isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite).select(F.col(key).cast("long").alias("id"), whole.alias("v"))


def _matrix(column):
    """Rows of a list column grouped by length: positions and the matrix of each length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield dim, at, flat[starts[at][:, None] + np.arange(dim)]


def _pivots(data, count):
    """The first ``count`` distinct vectors of twice as many rows by the hash of their id. A vector that
    very many rows share is thus one pivot."""
    rows = data.orderBy(F.xxhash64("id"), "id", "v").limit(2 * count).collect()
    found = {}
    for v in list(dict.fromkeys(tuple(r["v"]) for r in rows))[:count]:
        found.setdefault(len(v), []).append(v)
    return {dim: np.array(sorted(p), float) for dim, p in found.items()}


def _assign(pivots):
    """Adds ``cell``, ``dim``, the distance ``e`` to the pivot, the norm and a ``place`` that no other row has.
    Lengths without a pivot have one cell around 0."""
    def run(batches):
        at_row = TaskContext.get().partitionId() << 40
        for batch in batches:
            place = at_row + np.arange(batch.num_rows)
            at_row += batch.num_rows
            cell, dist = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            dims, norm = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for dim, at, m in _matrix(batch.column("v")):
                m = m.astype(float)
                p = pivots.get(int(dim), np.zeros((1, dim)))
                far = np.maximum((m**2).sum(1)[:, None] - 2 * m @ p.T + (p**2).sum(1), 0)
                cell[at], dims[at] = far.argmin(axis=1), dim
                dist[at] = np.sqrt(((m - p[cell[at]]) ** 2).sum(1))
                norm[at] = np.sqrt((m**2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(cell), pa.array(dist), pa.array(norm), pa.array(place)],
                                             [*batch.schema.names, "dim", "cell", "e", "norm", "place"])
    return run


_CELLS = "id long, v array<long>, dim long, cell long, e double, norm double, place long"


def _pack(assigned, rows):
    """Blocks of at most about ``rows`` rows: ``dim, cell, block, ids, m`` with the matrix as bytes. Rows are dealt
    by their stored place, so a task that runs again after a lost executor deals them alike."""
    counts = materialize(assigned.groupBy("dim", "cell").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks")), "cell-blocks")
    spread = assigned.join(counts, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("place"), F.col("blocks")).cast("int"))

    def pack(table):
        table = table.combine_chunks()
        (_, _, m), = _matrix(table.column("v"))
        ids = table.column("id").to_numpy()
        kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if abs(m).max() <= np.iinfo(t).max)
        return pa.table({"dim": table.column("dim")[:1], "cell": table.column("cell")[:1], "block": table.column("block")[:1],
                         "ids": pa.array([ids.tobytes()], pa.binary()), "m": pa.array([m.astype(kind).tobytes()], pa.binary())})
    return spread.select("dim", "cell", "block", "id", "v").groupBy("dim", "cell", "block").applyInArrow(pack, "dim long, cell long, block int, ids binary, m binary")


def _needed(pivots, cells, groups, k):
    """``(dim, group, cell)`` for every cell that a group's queries may need. ``ids`` of a cell belong to its
    ``near`` distances; without them every distance is that of an id of its own."""
    out = []
    by_dim = {}
    for c in cells:
        by_dim.setdefault(c["dim"], []).append(c)
    for g in groups:
        dim = g["dim"]
        own = by_dim.get(dim, [])
        p = pivots.get(dim, np.zeros((1, dim)))
        c, rho = p[g["cell"]], g["radius"]
        reach = min(np.linalg.norm(c) + rho, g["norm"])  # no query of the group is longer
        floors, tops = {}, []
        for cell in own:
            q = p[cell["cell"]]
            middle, length = float(c @ q), np.linalg.norm(q)
            near = np.array(cell["near"])
            ids = cell["ids"] if "ids" in cell else [(cell["cell"], i) for i in range(len(near))]
            for i, floor in zip(ids, (middle - rho * length - reach * near).tolist()):
                floors[i] = max(floor, floors.get(i, floor))
            tops.append(min(middle + rho * length + reach * cell["radius"], g["norm"] * cell["norm"]))
        floors = sorted(floors.values(), reverse=True)
        # one id may be the query's own, all of whose rows are left out, so the bound is the (k + 1)-th
        least = floors[k] if len(floors) > k else -np.inf
        slack = 1e-9 * (1 + abs(least)) if np.isfinite(least) else 0
        out += [(dim, g["cell"], cell["cell"]) for cell, top in zip(own, tops) if top >= least - slack]
    return out


def _product(q, x):
    """Exact inner products: in floating point where all sums stay below 2**53, else in integers."""
    top = float(abs(q).max(initial=0)) * float(abs(x).max(initial=0)) * q.shape[1]
    if top < 2**53:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def _solve(k):
    """Running top k of every query block over the data blocks that a task meets."""
    def run(batches):
        best = {}

        def flush():
            for ids, score, found in best.values():
                rows, cols = np.nonzero(score > LOWEST)
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(found[rows, cols]), pa.array(score[rows, cols])], ["query_id", "vec_id", "score"])
            best.clear()
        for batch in batches:
            names = ("dim", "group", "q_block", "q_ids", "q_m", "ids", "m")
            for dim, group, block, q_ids, q_m, ids, m in zip(*(batch.column(c).to_pylist() for c in names)):
                (qi, q), (xi, x) = _read(q_ids, q_m, dim), _read(ids, m, dim)
                if (dim, group, block) not in best:
                    if len(best) >= 64:
                        yield from flush()
                    best[dim, group, block] = (qi, np.full((len(qi), k), LOWEST), np.full((len(qi), k), -1))
                _, score, found = best[dim, group, block]
                s = _product(q, x)
                s[qi[:, None] == xi[None, :]] = LOWEST
                if len(xi) > 4 * k:  # keep what can reach the k-th score
                    cut = np.maximum(score[:, -1], np.partition(s, -k, axis=1)[:, -k])
                else:
                    cut = score[:, -1]
                for r in np.flatnonzero((s >= cut[:, None]).any(axis=1)):
                    take = np.flatnonzero((s[r] >= cut[r]) & (s[r] > LOWEST))
                    some, some_ids = np.r_[score[r], s[r, take]], np.r_[found[r], xi[take]]
                    order = np.lexsort((some_ids, -some))[:k]
                    score[r], found[r] = some[order], some_ids[order]
        yield from flush()
    return run


def _read(ids, m, dim):
    ids = np.frombuffer(ids, np.int64)
    width = len(m) // (len(ids) * dim)
    return ids, np.frombuffer(m, {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[width]).reshape(len(ids), dim)


def top_k(data, queries, k=20, pivots=PIVOTS):
    """``query_id, rank, vec_id, score``: the ``k`` best rows of ``data`` for each of ``queries`` (both
    ``id, v``)."""
    centres = _pivots(data, pivots)
    cells = materialize(data.mapInArrow(_assign(centres), _CELLS), "cells")
    groups = materialize(queries.distinct().mapInArrow(_assign(centres), _CELLS), "query-groups")
    # summaries: one row for each cell, at most PIVOTS for each length of vectors
    ids = cells.groupBy("dim", "cell", "id").agg(F.min("e").alias("e"))
    near = ids.withColumn("r", F.row_number().over(Window.partitionBy("dim", "cell").orderBy("e", "id"))).where(F.col("r") <= k + 1)
    nearest = near.groupBy("dim", "cell").agg(F.collect_list(F.struct("e", "id")).alias("near")).select(
        "dim", "cell", F.col("near.e").alias("near"), F.col("near.id").alias("ids"))
    spans = cells.groupBy("dim", "cell").agg(F.max("e").alias("radius"), F.max("norm").alias("norm"))
    found = spans.join(nearest, ["dim", "cell"]).collect()
    asked = groups.groupBy("dim", "cell").agg(F.max("e").alias("radius"), F.max("norm").alias("norm")).collect()
    pairs = _needed(centres, found, asked, k)

    spark = data.sparkSession
    plan = spark.createDataFrame(pairs, "dim long, group long, cell long")  # at most PIVOTS ** 2 rows for each length
    blocks = materialize(_pack(cells, BLOCK), "data-blocks")
    asking = materialize(_pack(groups, QUERY_BLOCK), "query-blocks").select(
        F.col("dim").alias("q_dim"), F.col("cell").alias("q_cell"), F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))
    sent = blocks.join(plan, ["dim", "cell"])
    met = sent.join(asking, (F.col("dim") == F.col("q_dim")) & (F.col("group") == F.col("q_cell")))
    partial = met.select("dim", "group", "q_block", "q_ids", "q_m", "ids", "m").mapInArrow(_solve(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
