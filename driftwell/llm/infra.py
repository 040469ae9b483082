"""What the operators share: shipping the package, cut points, buckets and blobs.

*Cut points.*  ``cut`` writes a DataFrame as Parquet below the folder named by
``spark.checkpoint.dir`` and reads it again, so a lost executor costs one step,
not the whole lineage.  Shuffle files of a step go as soon as it is written.

*Buckets.*  Rows are dealt by ``bucket_of`` (a hash of the whole row, never of a
key that can be hot), so groups have an even, bounded size.  Rows that are equal in
everything are alike to any hash; ``counted`` makes one row of those that come together.

*Blobs.*  Millions of small records (fingerprint, place) travel as binary values:
a few bytes a record instead of a JVM row.  Equal records are combined before they
leave their bucket of origin, so a key that a third of all rows hold reaches its
reducer once per bucket.  Key buckets are fewer than buckets of origin (``n_keys``),
and ``gathered`` joins what the buckets of a task send to one key bucket, so that a
value holds many records at any size: with 40,000 records a bucket of 1 MiB, some
5,000 at 30 GB (1,024 key buckets) and 3 at 100 TB (2 million of them).
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: set[str] = set()


#: Bytes of an Arrow batch, where the session leaves Spark's own bound: a worker holds a batch several times over as Python objects.
_BATCH, _BATCH_BYTES, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20, ("64m", "67108864b", "67108864")


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, where they don't have it on their path; and bound the session's Arrow batches."""
    if spark.conf.get(_BATCH) in _BATCH_DEFAULT:
        spark.conf.set(_BATCH, str(_BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(root)
    path = os.path.join(tempfile.mkdtemp(), f"{name}_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, root)))
    sc.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset on a local master (tests), one of our own; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        path = "file://" + os.path.join(tempfile.gettempdir(), f"driftwell-{os.getpid()}")
    return path.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    atexit.register(_remove, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


def discard(*cuts: DataFrame) -> None:
    """Removes the tables of cuts that no later step reads."""
    for df in cuts:
        _remove(df.sparkSession, df._cut_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the application may be gone already; the folder is the cluster's to clear then
        return


def bytes_of(df: DataFrame) -> int:
    """The optimizer's estimate of df's bytes (for a file scan: of its files)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Estimates above this many bytes stand for "unknown" (frames that are not read from files).
_KNOWN = 1 << 48
#: Buckets at most: at 100 TB a bucket has some 25 MB of files.
_MOST_BUCKETS = 1 << 22


def n_buckets(df: DataFrame, text_col: str, each: int = 1 << 20, least: int = 256) -> int:
    """A power of two so that a bucket has about `each` bytes of df's files; grows with the data.

    Where the plan has no estimate, the bytes of the texts are summed first."""
    size = bytes_of(df)
    if size >= _KNOWN:
        size = df.agg(F.sum(F.octet_length(F.col(f"`{text_col}`"))).alias("n")).first()["n"] or 0
    want = min(max(least, size // each), _MOST_BUCKETS)
    return 1 << (int(want) - 1).bit_length()


def n_keys(df: DataFrame, text_col: str, n: int) -> int:
    """Key buckets for n buckets of origin: a power of two so that each gets some 32 MiB of records; at least 256."""
    size = max(bytes_of(df) if bytes_of(df) < _KNOWN else 0, n << 20)
    return 1 << (int(min(max(256, size * 6 // 10 >> 25), _MOST_BUCKETS)) - 1).bit_length()


def row_id(*cols: Column | str) -> Column:
    """64 bits of the values and of which of them are null: a hash of values alone passes over nulls, wherever they are."""
    named = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.xxhash64(*named, *[F.isnull(c) for c in named])


def bucket_of(rid: Column, n: int) -> Column:
    return F.pmod(rid, F.lit(n)).cast("int")


def as_bytes(col: pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


def blobs(bucket: np.ndarray, rec: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(bucket, binary array): the records of each bucket as one value."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    ends = np.r_[cuts, len(bucket)].astype(np.int64) * rec.dtype.itemsize
    data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rec[order].tobytes())])
    return bucket[cuts].astype(np.int32), data.cast(pa.binary())


_held: dict[str, Callable[[], object]] = {}


def working(owner: str, clear: Callable[[], object]) -> None:
    """To be called by a task: what other operators left in this worker's caches goes, and its memory back to the system; clear empties the owner's."""
    others = [k for k in _held if k != owner]
    for k in others:
        _held.pop(k)()
    _held[owner] = clear
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows: what Python makes of a part is freed before the next."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
        del b
        pa.default_memory_pool().release_unused()


#: Bytes of records that a task gathers before it sends them, and of those that it sends at a time.
_GATHER, _SENT = 64 << 20, 4 << 20


def gathered(sent: DataFrame) -> DataFrame:
    """(key, srcs, sizes, data) of (src, key, data): the values of a task for one key as one, with their origins and lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("records", int)  # nothing of its own stays
        held: dict[int, list[tuple[int, bytes]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            """What is held, a part at a time: it goes as it is sent."""
            rows, part = [], 0
            for k in sorted(held):
                own = held.pop(k)
                rows.append((k, *(np.array([f(x) for x in own], "<u4").tobytes() for f in (lambda x: x[0], lambda x: len(x[1]))), b"".join(d for _, d in own)))
                part += len(rows[-1][3])
                if part > _SENT or not held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], names=["key", "srcs", "sizes", "data"])
                    rows, part = [], 0

        for b in batches:
            for s, k, d in zip(*(b.column(c).to_pylist() for c in ("src", "key", "data")), strict=True):
                held.setdefault(k, []).append((s, d))
                size += len(d)
            if size > _GATHER:
                yield from flush()
                size = 0
        yield from flush()

    return sent.select("src", "key", "data").mapInArrow(run, "key int, srcs binary, sizes binary, data binary")


def by_key(batches: Iterator[pa.RecordBatch], itemsize: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(key, origin of each record, records) of gathered rows that come sorted by key; of keys below 0, without the origins (records of any size)."""
    held: list[tuple[bytes, bytes, bytes]] = []
    now = None

    def whole() -> tuple[int, np.ndarray, bytes]:
        data = b"".join(x[2] for x in held)
        if now < 0:
            return now, np.zeros(0, np.int64), data
        srcs, sizes = (np.frombuffer(b"".join(x[i] for x in held), "<u4") for i in (0, 1))
        return now, np.repeat(srcs.astype(np.int64), sizes // itemsize), data

    for batch in batches:
        for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "srcs", "sizes", "data")), strict=True):
            if k != now:
                if held:
                    yield whole()
                held, now = [], k
            held.append(tuple(row))
    if held:
        yield whole()


def counted(df: DataFrame, rid: str = "rid") -> DataFrame:
    """df and copies: of rows with one rid (that are equal) in an Arrow batch one stays, with their number."""
    place = df.columns.index(rid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("rows", int)  # nothing of its own stays
        for b in batches:
            _, first, n = np.unique(b.column(place).to_numpy(), return_index=True, return_counts=True)
            order = np.argsort(first)
            at = pa.array(first[order])
            cols = b.columns if len(first) == b.num_rows else [c.take(at) for c in b.columns]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n[order].astype(np.int64))], names=[*b.schema.names, "copies"])

    return df.mapInArrow(run, df.select("*").schema.add("copies", "long"))


def in_order(table: pa.Table) -> pa.Table:
    """A bucket's rows by their numbers (rid, rid2), one of those that are equal, their copies added up.

    So a row has the same place whenever the bucket is read, however its rows came and
    whichever of them shared a batch, and bucket and place number a row without collisions."""
    table = table.sort_by([("rid", "ascending"), ("rid2", "ascending")])
    a, b = table["rid"].to_numpy(), table["rid2"].to_numpy()
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    if new.all():
        return table
    out = table.filter(pa.array(new))
    if "copies" in out.column_names:
        total = np.add.reduceat(table["copies"].to_numpy(), np.flatnonzero(new))
        out = out.set_column(out.column_names.index("copies"), "copies", pa.array(total.astype(np.int64)))
    return out


def joined(column: pa.ChunkedArray, dtype: np.dtype) -> np.ndarray:
    """The records of all values of a binary column, in order."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype=dtype)
