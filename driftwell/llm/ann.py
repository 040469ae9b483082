"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors are rotated at random, so every block of columns holds an even share of any
distance, and dealt to lists around centroids.  Inside a list the distance grows column
block by column block; after each block a hypothesis test compares the partial distance,
scaled to all columns, with the k-th best so far, and abandons candidates whose full
distance can hardly be smaller.  Survivors are ranked by their exact distance on the
original vectors.

A query looks into its nearest list first; its k-th distance there goes along as the
radius to the other lists it probes.  How many those are is read off the sample: as many
as hold the wanted share of true neighbours of sampled vectors among the sample.  Rows
and queries of a list meet in tasks of bounded size on both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .infra import cut, discard, ship

#: Vectors in the sample that the index is fitted on, and of it for a list at least; columns in a block; slack of the test, in deviations.
SAMPLE, FOR_A_LIST, BLOCK, SLACK = 32_768, 16, 16, 3.0
#: Vectors and queries of a list that meet in one task; sampled queries that the number of probes is read off; the share of neighbours that it must hold.
PART, QUERIES, ASKED, WANTED = 4096, 4096, 256, 0.95


def usable(vec: Column) -> Column:
    """Whether a vector is neither null nor empty nor zero and has finite components only."""
    x = F.transform(vec, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(vec) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _near(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each row, nearest first."""
    out, norm = np.empty((len(x), k), np.int64), (c * c).sum(1)[None]
    for a in range(0, len(x), 4096):
        d = norm - 2 * x[a : a + 4096] @ c.T
        out[a : a + 4096] = d.argmin(1)[:, None] if k == 1 else np.argsort(d, axis=1, kind="stable")[:, :k]
    return out


def _centroids(x: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), n, replace=False)]
    for _ in range(8):
        near = _near(x, c, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.bincount(near, minlength=n)[:, None]
        c = np.where(size > 0, sums / np.maximum(size, 1), c)
    return c


def _probes(x: np.ndarray, c: np.ndarray, k: int, wanted: float = WANTED) -> int:
    """Nearest lists that hold the wanted share of the k nearest in the sample of sampled vectors.

    In all rows neighbours are nearer than in a sample of them, so this errs on the safe side."""
    asked = np.random.default_rng(13).choice(len(x), min(ASKED, len(x)), replace=False)
    home, ranks = _near(x, c, 1)[:, 0], []
    for i in asked:
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        at = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        place = np.empty(len(c), np.int64)
        place[_near(x[i : i + 1], c, len(c))[0]] = np.arange(len(c))
        ranks.append(place[home[at]])
    ranks = np.sort(np.concatenate(ranks))
    return int(ranks[min(len(ranks) - 1, int(np.ceil(wanted * len(ranks))))]) + 1 if len(ranks) else 1


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows; others raise."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if not len(arr):
        return np.zeros((0, 1))
    flat, ends = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64), arr.offsets.to_numpy()
    if (np.diff(ends) != ends[1] - ends[0]).any():
        raise ValueError("vectors differ in length")
    return flat.reshape(len(arr), -1)


def scan(q: np.ndarray, blocks: list[np.ndarray], radius: float, slack: float = SLACK) -> np.ndarray:
    """Places of rows (rotated, in column blocks) that no test abandons, given the k-th best distance so far."""
    dims, b = sum(x.shape[1] for x in blocks), 0
    at = np.arange(len(blocks[0]))
    part = np.zeros(len(at))
    for x in blocks:
        part = part + ((x[at] - q[b : b + x.shape[1]]) ** 2).sum(1)
        b += x.shape[1]
        # a full distance of `radius` would show about this much in b of dims rotated columns, and all of it in the last
        most = radius * (1 + (slack / np.sqrt(b) if b < dims else 1e-9))
        stay = np.sqrt(part * dims / b) <= most
        at, part = at[stay], part[stay]
        if not len(at):
            break
    return at


def column_blocks(rotated: np.ndarray) -> list[np.ndarray]:
    return [np.ascontiguousarray(rotated[:, a : a + BLOCK]) for a in range(0, rotated.shape[1], BLOCK)]


def _search(k: int, rotation: np.ndarray) -> Callable[[pa.Table, pa.Table], pa.Table]:
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        rows = rows.sort_by("vec_id")
        ids, x = rows["vec_id"].to_numpy(), _matrix(rows["vec"])
        qid, q, known = queries["vec_id"].to_numpy(), _matrix(queries["vec"]), queries["radius"].to_numpy()
        rotated, rq, out = x @ rotation, q @ rotation, []
        blocks = column_blocks(rotated)
        for i in range(len(q)):
            best_d, best_at, radius, a = np.zeros(0), np.zeros(0, np.int64), known[i], 0
            while a < len(x):
                n = 512 if np.isinf(radius) else len(x)  # a first run gives a radius to the rest
                at = scan(rq[i], [c[a : a + n] for c in blocks], radius) + a
                at = at[ids[at] != qid[i]]
                d = np.sqrt(((x[at] - q[i]) ** 2).sum(1))
                d, at = np.concatenate((best_d, d)), np.concatenate((best_at, at))
                order = np.lexsort((ids[at], d))[:k]
                best_d, best_at = d[order], at[order]
                if len(best_d) == k:
                    radius = min(radius, best_d[-1])
                a += n
            out.append((np.full(len(best_at), qid[i]), ids[best_at], best_d))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=schema)

    return run


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, by Euclidean distance, nearest first.

    probes: lists that a query looks into; read off the sample if not given.  Candidates are
    all usable rows but those with the query's own id; ties go to the smaller id.  Defined
    results: unusable vectors (null, zero, non-finite, null inside), vectors of another
    length than most of the sample have (of equally frequent lengths the smaller counts) and
    null ids take no part; repeated rows are candidates once each, repeated queries count
    once; other columns are not read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    vec = F.col(f"`{vec_col}`")
    clean = lambda df: df.where(usable(vec) & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vec.alias("vec"))
    rows, asked = clean(vectors), clean(queries)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = np.diff(sample["vec"].combine_chunks().offsets.to_numpy())
    dims = int(np.argmax(np.bincount(sizes)))
    x = _matrix(sample["vec"].combine_chunks().filter(pa.array(sizes == dims)))
    rows, asked = rows.where(F.size("vec") == dims), asked.where(F.size("vec") == dims).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    total, n_asked = rows.count(), asked.count()
    rotation = np.linalg.qr(np.random.default_rng(11).standard_normal((dims, dims)))[0]
    n = int(np.clip(np.sqrt(total), 1, max(1, len(x) // FOR_A_LIST)))
    centers = _centroids(x, n)
    looked = min(n, probes or _probes(x, centers, k))
    held = spark.sparkContext.broadcast(centers)  # at most SAMPLE / FOR_A_LIST vectors
    vec_type = rows.schema["vec"].dataType.simpleString()

    def assign(start: int, stop: int) -> Callable:
        """Each row beside its nearest lists from start on, up to stop."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                    near = _near(_matrix(b.column("vec")), held.value, stop)[:, start:]
                    at = pa.array(np.repeat(np.arange(b.num_rows), stop - start))
                    yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns), pa.array(near.ravel().astype(np.int32))], names=[*b.schema.names, "list"])

        return run

    # parts of a list, and groups of its queries: as many as its share of the sample asks for
    share = np.bincount(_near(x, centers, 1)[:, 0], minlength=n) / len(x)
    parts = F.array(*[F.lit(max(1, int(np.ceil(total * s / PART)))) for s in share])[F.col("list")]
    placed = rows.mapInArrow(assign(0, 1), f"vec_id long, vec {vec_type}, list int").withColumn("part", F.pmod(F.xxhash64("vec_id", "vec"), parts).cast("int"))
    placed = cut(placed, "lists")

    def meet(ask: DataFrame, lists: int) -> DataFrame:
        groups = max(1, -(-n_asked * lists // (n * QUERIES)))
        chunk = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(groups)).cast("int")
        right = ask.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("chunk", chunk)
        left = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        keys = ["list", "part", "chunk"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k, rotation), "query_id long, vec_id long, score double")

    asked_type = f"vec_id long, vec {vec_type}, radius double, list int"
    first = cut(meet(asked.withColumn("radius", F.lit(float("inf"))).mapInArrow(assign(0, 1), asked_type), 1), "first")
    best = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    if looked == 1:
        found = first
    else:
        radius = best(first).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("radius"))
        known = asked.join(radius, "vec_id", "left").select("vec_id", "vec", F.coalesce("radius", F.lit(float("inf"))).alias("radius"))
        more = cut(meet(known.mapInArrow(assign(1, looked), asked_type), looked - 1), "more")
        found = first.unionByName(more)
    out = cut(best(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "nearest")
    discard(placed)
    return out
