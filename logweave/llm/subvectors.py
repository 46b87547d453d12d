"""Centroid clustering over subvector dictionaries.

1. Encoding. Vectors become whole numbers ``floor(scale * x)``. They are stored once as chunks of at most
   ``CHUNK`` rows: each block of ``WIDTH`` dimensions of a chunk is replaced by codes into the dictionary
   of its distinct subvectors. The encoding loses nothing; chunks are written to the shared folder.
2. Distances. A round computes the exact squared distance of every dictionary entry to every centroid
   once; the distance of a vector is the sum of its codes' partial distances.
3. Update. How often a cluster uses a code, times the code's subvector, is the cluster's exact sum. A
   chunk reports one row of sums per cluster, which Spark adds up; vectors never leave their task.
   Only the ``k`` centroids travel.

Centroids start as the ``k`` vectors with the smallest SHA-256 of ``<seed>:<id>``. Ties of a distance go
to the smaller centroid number, an empty cluster keeps its centroid. Results are exact whole numbers;
components must lie within ``LARGEST``, beyond which squared distances leave 64 bits: an error.

Nulls and edges: vectors that are null, have another number of components or hold null or non-finite
ones take no part. Repeated rows are rows of their own. Rows with a null id are clustered and come
back with a null id, but start no cluster unless ids run out; rows of one id start in vector order.
With fewer than ``k`` vectors there are as many clusters; an empty table gives no rows.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from logweave.session import materialize, spread

CHUNK = 16_384
WIDTH = 2
LARGEST = 2**27


def whole_vectors(df, vector="embedding", key="vec_id", dim=64, scale=64):
    """``id, v`` of the vectors that take part, as whole numbers."""
    x = F.col(vector)
    usable = x.isNotNull() & (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(usable).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def first_centroids(vectors, k, seed):
    """The ``k`` starting vectors, as an array of one row each."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select(order.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def encode_blocks(m, width=WIDTH):
    """Codes (rows x blocks) of a matrix and the distinct subvectors of each block."""
    codes, books = [], []
    for at in range(0, m.shape[1], width):
        part = m[:, at:at + width]
        order = np.lexsort(part.T[::-1])
        ranked = part[order]
        fresh = np.ones(len(part), bool)
        fresh[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
        code = np.empty(len(part), np.int64)
        code[order] = np.cumsum(fresh) - 1
        codes.append(code)
        books.append(ranked[fresh])
    return np.stack(codes, axis=1), books


_CHUNK = "n int, ids binary, known binary, codes binary, sizes array<int>, books binary"


def _chunks(dim, size):
    def run(batches):
        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                held.append(part)
                rows += part.num_rows
                if rows >= size:
                    yield _chunk(held, dim)
                    held, rows = [], 0
        if rows:
            yield _chunk(held, dim)
    return run


def _chunk(batches, dim):
    ids = pa.concat_arrays([b.column("id") for b in batches])
    m = pa.concat_arrays([b.column("v").flatten() for b in batches]).to_numpy(zero_copy_only=False).reshape(-1, dim)
    if abs(m).max() > LARGEST:
        raise ValueError(f"a scaled component exceeds {LARGEST}; distances would leave 64 bits")
    codes, books = encode_blocks(m)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    cells = [len(m), ids.fill_null(0).to_numpy(zero_copy_only=False).tobytes(), known.tobytes(), codes.astype(np.uint16).tobytes(),
             [len(b) for b in books], np.concatenate([b.ravel() for b in books]).tobytes()]
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds)], ["n", "ids", "known", "codes", "sizes", "books"])


def encoded(vectors, dim, size=CHUNK):
    """The chunks of ``vectors`` (``id, v``), written out."""
    return materialize(spread(vectors).mapInArrow(_chunks(dim, min(size, 1 << 15)), _CHUNK), "subvectors")


def _read(batches, dim):
    """Per chunk: ids, validity, codes and each block's first dimension with its dictionary."""
    for batch in batches:
        for row in range(batch.num_rows):
            n, ids, known, codes, sizes, flat = (batch.column(c)[row].as_py() for c in ("n", "ids", "known", "codes", "sizes", "books"))
            flat, at, books = np.frombuffer(flat, np.int64), 0, []
            for block, size in enumerate(sizes):
                width = min(WIDTH, dim - block * WIDTH)
                books.append((block * WIDTH, flat[at:at + size * width].reshape(size, width)))
                at += size * width
            yield np.frombuffer(ids, np.int64), np.frombuffer(known, bool), np.frombuffer(codes, np.uint16).reshape(n, len(books)), books


def nearest(codes, books, centroids):
    """Number and squared distance of the nearest centroid of every row."""
    total = np.zeros((len(codes), len(centroids)), np.int64)
    for block, (at, book) in enumerate(books):
        part = centroids[:, at:at + book.shape[1]]
        partial = ((book[:, None, :] - part[None]) ** 2).sum(axis=2)  # once per distinct subvector
        total += partial[codes[:, block]]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(total)), cluster]


def _sums(centroids):
    """Count and component sums of each cluster in a chunk."""
    k, dim = centroids.shape

    def run(batches):
        for _, _, codes, books in _read(batches, dim):
            cluster, _ = nearest(codes, books, centroids)
            sums = np.zeros((k, dim), np.int64)
            for block, (at, book) in enumerate(books):
                used = np.bincount(cluster * len(book) + codes[:, block], minlength=k * len(book)).reshape(k, len(book))
                sums[:, at:at + book.shape[1]] = used @ book
            count = np.bincount(cluster, minlength=k)
            own = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(count[own]), pa.array(sums[own].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])
    return run


def _assigned(centroids):
    def run(batches):
        for ids, known, codes, books in _read(batches, centroids.shape[1]):
            cluster, distance = nearest(codes, books, centroids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])
    return run


def next_centroids(chunks, centroids):
    """Floors of the exact means; at most one row per cluster reaches the driver."""
    k, dim = centroids.shape
    part = chunks.mapInArrow(_sums(centroids), "cluster long, n long, sums array<long>")
    total = part.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i].cast("decimal(20,0)")) for i in range(dim)]).alias("sums"))
    out = centroids.copy()
    for row in total.collect():
        out[row["cluster"]] = [int(s) // row["n"] for s in row["sums"]]
    return out


def cluster(vectors, k=16, rounds=3, seed=1, dim=64):
    """``vec_id, cluster, distance`` of every vector after ``rounds`` updates, and the final centroids."""
    vectors = vectors.select("id", "v")
    chunks = encoded(vectors, dim)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        centroids = next_centroids(chunks, centroids)
    return materialize(chunks.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "assigned"), centroids


def report(assigned, centroids):
    """``assigned`` with inertias and the digest of each vector's centroid."""
    spark = assigned.sparkSession
    digests = [(i, hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()) for i, c in enumerate(centroids)]
    inertia = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # one row per cluster
    own = {r["cluster"]: r["cluster_inertia"] for r in inertia}
    rows = [(i, own.get(i, 0), sum(own.values()), d) for i, d in digests]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
