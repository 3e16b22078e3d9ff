"""Approximate nearest neighbours with randomly rotated one-bit codes.

Index: every vector is centred, rotated by a seeded random rotation and kept as
one sign bit per dimension with two scalars: its distance to the centre and the
inner product of the unit vector with its own code. With these the inner
product of any query with the unit vector is estimated without bias, and its
error is bounded by ``epsilon`` standard errors. The product of a query with a
code is a sum of table entries, one for each byte of the packed code.

Search meets blocks of the index with groups of queries. In a block the best few
by estimate are computed exactly; every vector whose lower bound does not exceed
the k-th exact distance is reranked on the original vectors in double precision.
Each block returns k rows a query, which are merged. A vector is sent once for
each group of queries and a query once for each block, both of bounded size.

The centre is the mean of the first ``sample_rows`` rows; any centre gives right
results, only tighter or wider bounds.

Vectors that are null, zero, of another length than ``dim`` (by default that of
the valid vector with the smallest id), or with null or non-finite components
take no part. Rows repeated with one id count once, by the nearest of them. Ties
go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULT = "query_id long, vec_id long, score double"
#: The signs of the bits of a byte, the first bit being the highest.
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1


def valid(embedding: Column) -> Column:
    """Has components, all finite, not all zero."""
    big = F.lit(float("inf"))
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return embedding.isNotNull() & (F.size(embedding) > 0) & fine & F.exists(embedding, lambda x: x != 0)


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, distance to the centre, inner product of unit vector and code)."""
    y = (x - centre) @ turn
    norm = np.sqrt((y * y).sum(1))
    unit = y / np.where(norm > 0, norm, 1)[:, None]
    return np.packbits(unit > 0, axis=1), norm, np.abs(unit).sum(1) / np.sqrt(x.shape[1])


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in chunks]
    return (np.concatenate(flat) if flat else np.zeros(0)).reshape(-1, dim)


def exact_distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, summed over dimensions in order."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += (x[:, j].astype(np.float64) - float(q[j])) ** 2
    return np.sqrt(total)


def code_products(codes: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of a rotated query with packed sign codes (bits beyond the dimension count nothing)."""
    padded = np.zeros(8 * codes.shape[1])
    padded[: len(y)] = y
    table = padded.reshape(-1, 8) @ _SIGNS.T  # for each byte of a code and each value of it
    out = np.zeros(len(codes))
    for j in range(codes.shape[1]):
        out += table[j][codes[:, j]]
    return out


def _nearest_ids(ids: np.ndarray, distances: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest distinct ids with their distances."""
    order = np.lexsort((ids, distances))
    ids, distances = ids[order], distances[order]
    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return ids[first], distances[first]


def search_block(ids, x, codes, norm, own, queries, query_ids, centre, turn, k: int, epsilon: float):
    """The k nearest rows of one block for each query: (query ids, ids, distances)."""
    dim = x.shape[1]
    y = (queries - centre) @ turn
    q_norm = np.sqrt((y * y).sum(1))
    safe = np.where(own > 0, own, 1)
    # standard error of the estimated inner product of unit vectors
    spread = np.where(own > 0, np.sqrt(np.maximum(1 - safe**2, 0)) / safe, 1) * epsilon / np.sqrt(max(dim - 1, 1))
    out = []
    for i, query_id in enumerate(query_ids):
        inner = code_products(codes, y[i]) / np.sqrt(dim) / safe
        base = norm**2 + q_norm[i] ** 2
        estimate = base - 2 * norm * inner
        low = estimate - 2 * norm * q_norm[i] * spread
        low[ids == query_id] = estimate[ids == query_id] = np.inf
        first = np.argpartition(estimate, min(2 * k, len(ids) - 1))[: 2 * k]
        first = first[np.isfinite(estimate[first])]
        if not len(first):
            continue
        _, reach = _nearest_ids(ids[first], exact_distances(x[first], queries[i]), k)
        at = np.flatnonzero(low <= reach[-1] ** 2 + 1e-6 * base) if len(reach) == k else np.flatnonzero(np.isfinite(low))
        found, d = _nearest_ids(ids[at], exact_distances(x[at], queries[i]), k)
        out.append((np.full(len(found), query_id), found, d))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, dim: int | None = None, seed: int = 5, epsilon: float = 4.0, sample_rows: int = 4_096, block_rows: int = 65_536, query_rows: int = 65_536) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows for each row of ``vectors`` (vec_id, embedding) where ``is_query`` holds."""
    rows = vectors.where(valid(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("asks")).where("vec_id is not null")
    if dim is None:
        head = rows.agg(F.min_by(F.size("embedding"), "vec_id")).first()[0]
        dim = int(head) if head else 1
    rows = rows.where(F.size("embedding") == dim)
    n, n_queries = rows.agg(F.count("*"), F.count_if("asks")).first()
    # take() reads as many partitions as it needs
    sample = np.array([r[0] for r in rows.select("embedding").take(sample_rows)], np.float64)
    centre = sample.mean(0) if len(sample) else np.zeros(dim)
    turn = rotation(dim, seed)
    blocks, groups = max(1, -(-n // block_rows), min(12, n // 1000)), max(1, -(-n_queries // query_rows))

    def index(batches):
        for b in batches:
            codes, norm, own = encode(_matrix(b.column("embedding"), dim).astype(np.float64), centre, turn)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm, pa.float64()), pa.array(own, pa.float64())], names=["vec_id", "embedding", "code", "norm", "own"])

    # vectors keep the width in which they are stored
    stored_type = rows.schema["embedding"].dataType.simpleString()
    place = lambda count, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(count)).cast("int")
    coded = rows.select("vec_id", "embedding").mapInArrow(index, f"vec_id long, embedding {stored_type}, code binary, norm double, own double")
    coded = coded.withColumn("block", place(blocks, 1)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = rows.where("asks").select("vec_id", "embedding", place(groups, 2).alias("part")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if left.num_rows and right.num_rows:
            query_ids, first = np.unique(right.column("vec_id").to_numpy(), return_index=True)
            codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(left.num_rows, -1)
            queries = _matrix(right.column("embedding"), dim)[first].astype(np.float64)
            found = search_block(left.column("vec_id").to_numpy(), _matrix(left.column("embedding"), dim), codes, left.column("norm").to_numpy(), left.column("own").to_numpy(), queries, query_ids, centre, turn, k, epsilon)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    found = coded.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(search, RESULT)
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
