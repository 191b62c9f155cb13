"""Approximate nearest neighbours by inner product, with cross-polytope hashing.

Vectors fall into bands by their norms, each from half its longest norm up. Within a
band they are scaled by the longest norm and given one more coordinate that makes them
unit vectors, queries are scaled to unit length; the largest inner product then is the
smallest angle. One band for all would not do: beside a much longer vector all others
nearly coincide with the added axis, in buckets that say nothing about a query. A fast pseudo-rotation (three rounds of random signs and a Hadamard
transform) is drawn for each table, and a vector's bucket is the signed axis it is
nearest to. A query probes its ``probes`` nearest signed axes in each table of each band.
Bands of up to ``part`` vectors, such as a few long ones, are not hashed: every query
meets all of them. What a query meets is scored in double precision on the original
vectors.

Buckets are split into parts of about ``part`` vectors by a hash of the id, and the
queries that probe a bucket go to each of its parts, so that a bucket that holds a third
of all vectors is many tasks. A part returns each query's best ``k`` only. Queries that
met fewer than ``k`` others are scored against the whole table, part by part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ratelens.session import cut_lineage

AXES = 64
WHOLE = -1


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.float32(np.sqrt(d))


def _axes(x: np.ndarray, table: int) -> np.ndarray:
    """The vectors' products with the signed axes of a table."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), d), np.float32)
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([17, table, d])
    for _ in range(3):
        y = _hadamard(y * rng.choice(np.array([-1, 1], np.float32), d))
    y = y[:, : min(d, AXES)]
    return np.concatenate((y, -y), axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _hashed(tables: int, probes: int, bands: dict[int, tuple[int, float]]):
    """(id, v, band, length) to (id, v, bucket) rows; probes is 0 for the vectors themselves,
    otherwise for queries. ``bands``: the number and the longest length (a binary logarithm)
    of each hashed band; the vectors of all others share the bucket ``WHOLE``."""

    def job(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"))
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x, more, first = x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x)), np.zeros((len(x), 1), np.int64)
            hashed, firsts = np.ones(len(x), bool), [n * tables * 2 * AXES for n, _ in bands.values()]
            if not probes:
                own = [bands.get(b, (-1, 0.0)) for b in batch.column("band").to_pylist()]
                number, longest = (np.array(c) for c in zip(*own, strict=True))
                hashed, first = number >= 0, (number * tables * 2 * AXES)[:, None]
                part = np.exp2(np.minimum(0, batch.column("length").to_numpy() - longest))
                x, more = x * part[:, None], np.sqrt(np.maximum(0, 1 - part * part))

            def found(rows, bucket):
                rows = pa.array(rows)
                return pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("v").take(rows), pa.array(bucket, pa.int32())], ["id", "v", "bucket"])

            rows = np.arange(len(x)) if probes else np.flatnonzero(~hashed)
            yield found(rows, np.full(len(rows), WHOLE))
            hashed = np.flatnonzero(hashed)
            if not bands or not len(hashed):
                continue
            x = np.concatenate((x, more[:, None]), axis=1).astype(np.float32)[hashed]
            for table in range(tables):
                y = _axes(x, table)
                many = min(probes, y.shape[1])
                near = np.argpartition(-y, many - 1, axis=1)[:, :many] if probes else y.argmax(1)[:, None]
                near = near + table * 2 * AXES
                for start in firsts if probes else [first[hashed]]:
                    yield found(np.repeat(hashed, near.shape[1]), (near + start).ravel())

    return job


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the components."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += q[:, j] * x[:, j]
    return total


def _best(k: int):
    """Each query's best k ids but its own of the distinct (id, v) in one part of a bucket."""

    def job(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            ids, q_ids = right.column("id").to_numpy(), left.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x, q = ids[order], _matrix(right.column("v"))[order], _matrix(left.column("v"))
            single, starts = np.unique(ids, return_index=True)
            distinct, of = np.unique(x, axis=0, return_inverse=True)  # equal vectors are scored once
            of = of.ravel()
            by_vector = np.argsort(of, kind="stable")
            bounds = np.searchsorted(of[by_vector], np.arange(len(distinct) + 1))
            for at in range(0, len(q), 256):
                s = q[at : at + 256] @ distinct.T
                if len(starts) == len(ids):
                    # one place more, as the query itself may stand among them
                    least = np.partition(s, max(0, s.shape[1] - k - 1), axis=1)[:, max(0, s.shape[1] - k - 1)]
                else:  # the best k ids, of which each may have many vectors
                    each = np.maximum.reduceat(s[:, of], starts, axis=1)
                    own = np.searchsorted(single, q_ids[at : at + 256]).clip(max=len(single) - 1)
                    held = np.flatnonzero(single[own] == q_ids[at : at + 256])
                    each[held, own[held]] = -np.inf
                    least = np.partition(each, max(0, each.shape[1] - k), axis=1)[:, max(0, each.shape[1] - k)]
                row, col = np.nonzero(s >= (least - 1e-9 * (1 + np.abs(least)))[:, None])
                score = _products(q[at + row], distinct[col])
                many = np.minimum(bounds[col + 1] - bounds[col], k + 1)  # an id stands once among equal vectors
                member = by_vector[np.repeat(bounds[col] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())]
                row, score, found = np.repeat(row, many), np.repeat(score, many), ids[member]
                own = found != q_ids[at + row]
                row, score, found = row[own], score[own], found[own]
                order = np.lexsort((-score, found, row))
                row, score, found = row[order], score[order], found[order]
                best = np.ones(len(row), bool)
                best[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
                row, score, found = row[best], score[best], found[best]
                order = np.lexsort((found, -score, row))
                row, score, found = row[order], score[order], found[order]
                first = np.searchsorted(row, row)
                top = np.arange(len(row)) - first < k
                out.append((q_ids[at + row[top]], found[top], score[top]))
        query, vec, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())})

    return job


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = 8, probes: int = 20, part: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row of ``queries`` the ``k`` rows of ``vectors`` found with the largest
    inner product, but for the row of the same id: (query_id, rank from 1, vec_id, score),
    ties to the smaller vec_id. ``score`` is the product of the original vectors in double
    precision. More ``tables`` or ``probes`` find more of the true neighbours. A query has
    fewer rows only where there are fewer candidates, and then has all of them.

    Vectors that are null, empty, zero or hold a null or non-finite component take no
    part, nor do rows without an id and vectors whose length is not the most frequent one
    (of equally frequent ones, the longest). Equal vectors are found by their ids like
    any others; of rows that repeat an id, one of those with the best score counts.
    """

    def usable(df):
        v = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
        df = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0")
        df = df.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))
        most = F.array_max(F.transform("v", F.abs))  # scaled by it, squares neither overflow nor vanish
        df = df.withColumn("most", most).withColumn("sum", F.aggregate("v", F.lit(0.0), lambda t, c: t + (c / F.col("most")) * (c / F.col("most"))))
        return df.select("id", "v", (F.log2("most") + F.log2("sum") / 2).alias("length"), F.size("v").alias("size"))

    all_vectors, all_queries = usable(vectors), usable(queries)
    shape = all_vectors.groupBy("size").agg(F.count("*").alias("n"), F.max("length").alias("longest")).orderBy(F.desc("n"), F.desc("size")).first()
    size, longest = (shape["size"], shape["longest"]) if shape else (0, 0.0)
    band = F.floor(longest - F.col("length")).cast("int").alias("band")  # doubles have about 2,100
    all_vectors, all_queries = (d.where(F.col("size") == size).select("id", "v", band, "length").dropDuplicates(["id", "v"]) for d in (all_vectors, all_queries))
    large = all_vectors.groupBy("band").agg(F.count("*").alias("n"), F.max("length").alias("longest")).where(F.col("n") > part).collect()
    bands = {r["band"]: (n, r["longest"]) for n, r in enumerate(sorted(large))}
    schema = "id long, v array<double>, bucket int"
    stored = cut_lineage(all_vectors.mapInArrow(_hashed(tables, 0, bands), schema), "buckets")
    # the bucket that every query probes is cut finer: it may be the only one
    at_most = F.when(F.col("bucket") == WHOLE, max(1, part // 16)).otherwise(part)
    parts = stored.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.ceil(F.col("n") / at_most).cast("int").alias("parts"))
    probing = all_queries.mapInArrow(_hashed(tables, probes, bands), schema)
    parts = F.broadcast(cut_lineage(parts, "parts"))  # one row for each of the bands' and tables' axes
    right = stored.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("long"))).drop("parts")
    left = probing.join(parts, "bucket").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).drop("parts")
    keys = ("bucket", "part")

    def met(left, right):
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best(k), "query_id long, vec_id long, score double")
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    found = cut_lineage(met(left, right), "met")
    total = all_vectors.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids")).first()
    counts = found.groupBy("query_id").agg(F.count("*").alias("met"))
    short = all_queries.select(F.col("id").alias("query_id")).distinct().join(counts, "query_id", "left")
    short = cut_lineage(short.where(F.coalesce("met", F.lit(0)) < min(k, total["ids"])).select("query_id"), "short")
    if total["ids"] and not short.isEmpty():
        many = math.ceil(total["rows"] / part)
        again = all_queries.join(short, F.col("id") == F.col("query_id"), "left_semi")
        left = again.select("id", "v", F.lit(WHOLE).alias("bucket"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))).alias("part"))
        right = all_vectors.select("id", "v", F.lit(WHOLE).alias("bucket"), F.pmod(F.xxhash64("id"), F.lit(many).cast("long")).alias("part"))
        found = found.join(short, "query_id", "left_anti").unionByName(met(left, right))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
