"""N-gram Jaccard join: size-aware, heavy-light.

A document is the set of its distinct k-word shingles; two link when
den * |A & B| >= num * |A | B|.  Let o(n) = ceil(num * n / den): a set of n shingles
shares at least o(n) of them with every partner.

1. *Screen.*  In the order of their hashes, the i-th common shingle of linked sets is
   among the first n - o(n) + i of both.  With l(n) about half of n - o(n), each set shows
   its first n - o(n) + l(n) shingles, and a linked one sees l(o(n)) of them elsewhere
   (its smallest partner has o(n) shingles).  Documents that see fewer are done.
   Documents with equal sets become one.
2. *Counts.*  The rest count how many of them hold each shingle.  Fewer than o(n)
   shingles held elsewhere: no link.  From here the order is rarest first.
3. *Heavy and light.*  Sets of fewer than B shingles send the 2-subsets of their first
   n - o(n) + 2 shingles (linked light sets share one); the others send their first
   n - o(n) + 1 shingles to inverted lists, and so do light ones large enough to link
   with a heavy one.  B is the cheapest boundary by the counts at hand.
4. *Lists.*  Each document of a list is compared with its smallest one, exactly.  Lists
   whose documents are in one component by now need no more.  The documents of the
   others fall into groups that share lists; a group is cut into blocks of so many
   documents and shingles, and each two blocks meet in a task, which compares two documents only while they share a first
   shingle and no chain of links joins them.  It returns the links of a spanning forest,
   so no group emits its pairs, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .infra import as_bytes, blobs, bucket_of, by_key, counted, cut, discard, gathered, in_order, joined, n_buckets, n_keys, row_id, ship
from .substring_dedup import _send, shared_places
from .wordhash import U, Words, mix

_FIRST = "src int, key int, data binary, rid long, rid2 long, v long, n long, d1 long, d2 long"
_SETS = "src int, key int, data binary, rid long, n long, toks binary"
_READY = "rid long, n long, toks binary, first binary, single long, c1 double, c2 double"
_LOCAL = np.dtype([("a", "<u4"), ("b", "<u2"), ("n", "<u4")])
_DF = np.dtype([("t", "<u8"), ("n", "<u4")])
#: Sets of this size and more are heavy at any boundary; it bounds the table of costs on the driver.
MOST_LIGHT = 512
#: Documents of a block, as long as a group has at most MOST_BLOCKS blocks; documents of the blocks of larger groups; shingles of a block, about.
BLOCK, MOST_BLOCKS, LARGE_BLOCK, SHINGLES = 128, 128, 16_384, 4_000_000


def _sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, document) sorted by document then shingle, distinct; sizes of all sets."""
    w = Words(texts, lower=True)
    h, ok = w.windows(k), w.inside(k)
    d, h = w.doc[: len(h)][ok], h[ok]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):  # the whole sequence is the one shingle
        whole = np.fromiter((_whole(w.hash[w.first[i] : w.first[i + 1]]) for i in short), np.uint64, len(short))
        d, h = np.concatenate((d, short)), np.concatenate((h, whole))
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
    h, d = h[new], d[new]
    return h, d, np.bincount(d, minlength=len(texts))


def _whole(words: np.ndarray) -> int:
    x = U(len(words) + 1)
    with np.errstate(over="ignore"):
        for y in words:
            x = mix(np.array([x * U(0x9E3779B97F4A7C15) + y], np.uint64))[0]
    return int(x)


def _need(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return -(-num * n // den)


def _depth(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Shingles beyond the plain prefix (counted from 1) that a set of n sends to the screen; never falls with n."""
    return np.maximum(1, (n - _need(n, num, den) + 1) // 2)


def _vertices(docs: pa.Table) -> np.ndarray:
    """The numbers of a bucket's rows from here on: bucket and place, so no two rows share one (there are at most 2^22 buckets)."""
    return (docs["src"].to_numpy().astype(np.int64) << 32) + np.arange(docs.num_rows)


def _screen(k: int, num: int, den: int, n_keys: int) -> Callable[[pa.Table], pa.Table]:
    schema = pa.schema([("src", pa.int32()), ("key", pa.int32()), ("data", pa.binary()), *((c, pa.int64()) for c in ("rid", "rid2", "v", "n", "d1", "d2"))])

    def send(table: pa.Table) -> pa.Table:
        table = in_order(table)
        h, d, n = _sets(as_bytes(table["text"]), k)
        rank = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        first = rank < (n - _need(n, num, den) + _depth(n, num, den))[d]
        sent = _send(table["src"][0].as_py(), h[first], np.zeros(int(first.sum()), np.uint64), d[first], n_keys)
        with np.errstate(over="ignore"):
            ends, total = np.cumsum(n), []
            for salt in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
                run = np.r_[U(0), np.cumsum(mix(h * U(salt)))]
                total.append(mix((run[ends] - run[ends - n]) + n.astype(np.uint64) * U(salt)).view(np.int64))
        info = pa.table({"rid": table["rid"], "rid2": table["rid2"], "v": pa.array(_vertices(table)), "n": pa.array(n.astype(np.int64)), "d1": pa.array(total[0]), "d2": pa.array(total[1])})
        return pa.concat_tables([sent, info], promote_options="default").select(schema.names).cast(schema)

    return send


def _collect(k: int, num: int, den: int, n_keys: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Sets of the documents that the screen leaves, and their counts in this bucket."""
    schema = pa.schema([("src", pa.int32()), ("key", pa.int32()), ("data", pa.binary()), ("rid", pa.int64()), ("n", pa.int64()), ("toks", pa.binary())])

    def send(docs: pa.Table, hits: pa.Table) -> pa.Table:
        docs = in_order(docs)
        at, seen = np.unique(joined(hits["data"], np.dtype("<u4")).astype(np.int64), return_counts=True)
        new = ~np.isin(_vertices(docs)[at], hits["rid"].drop_null().to_numpy())
        at, seen = at[new], seen[new]
        if not len(at):
            return schema.empty_table()
        src = docs["src"][0].as_py()
        docs = docs.append_column("v", pa.array(_vertices(docs))).take(pa.array(at))
        h, d, n = _sets(as_bytes(docs["text"]), k)
        stays = seen >= _depth(_need(n, num, den), num, den)
        h, n, at, docs = h[stays[d]], n[stays], at[stays], docs.filter(pa.array(stays))
        cuts = np.r_[0, np.cumsum(n)]
        raw = h.astype("<u8").tobytes()
        sets = pa.table({"src": pa.array(np.full(len(at), src, np.int32)), "rid": docs["v"], "n": pa.array(n.astype(np.int64)), "toks": pa.array([raw[8 * a : 8 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})
        tok, count = np.unique(h, return_counts=True)
        rec = np.zeros(len(tok), dtype=_LOCAL)
        rec["a"], rec["b"], rec["n"] = tok >> U(32), (tok >> U(16)).astype(np.uint16), count
        key, data = blobs((tok & U(n_keys - 1)).astype(np.int64), rec)
        part = pa.table({"src": pa.array(np.full(len(key), src, np.int32)), "key": pa.array(key), "data": data})
        return pa.concat_tables([sets, part], promote_options="default").select(schema.names).cast(schema)

    return send


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per key bucket (rows come sorted by it): shingles (their upper 48 bits) held more than once, with counts, by bucket of origin."""
    for now, src, data in by_key(batches, _LOCAL.itemsize):
        rec = np.frombuffer(data, dtype=_LOCAL)
        h = (rec["a"].astype(np.uint64) << U(16)) | rec["b"]
        _, group = np.unique(h, return_inverse=True)
        total = np.bincount(group, weights=rec["n"])[group]
        many = total > 1
        out = np.zeros(int(many.sum()), dtype=_DF)
        out["t"], out["n"] = (h[many] << U(16)) | U(now), np.minimum(total[many], 0xFFFFFFFF)
        key, blob = blobs(src[many], out)
        yield pa.RecordBatch.from_arrays([pa.array(key), blob], names=["src", "data"])


def _prefixes(num: int, den: int, n_keys: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    schema = pa.schema([("rid", pa.int64()), ("n", pa.int64()), ("toks", pa.binary()), ("first", pa.binary()), ("single", pa.int64()), ("c1", pa.float64()), ("c2", pa.float64())])
    # counts are by the 48 upper bits and the bits of the key bucket; the few shingles that agree in those share a count, which any order allows
    mask = (U(0xFFFFFFFFFFFF) << U(16)) | U(n_keys - 1)

    def ready(sets: pa.Table, counts: pa.Table) -> pa.Table:
        df = joined(counts["data"], _DF)
        df = df[np.argsort(df["t"])]
        if not sets.num_rows or not len(df):
            return schema.empty_table()
        rows = {c: [] for c in schema.names}
        for rid, n, raw in zip(sets["rid"].to_pylist(), sets["n"].to_pylist(), sets["toks"].to_pylist(), strict=True):
            tok = np.frombuffer(raw, "<u8")
            look = tok & mask
            at = np.minimum(np.searchsorted(df["t"], look), len(df) - 1)
            seen = df["t"][at] == look
            need, shared = -(-num * n // den), int(seen.sum())
            if shared < need:
                continue
            tok, count = tok[seen], df["n"][at][seen]
            single = n - need + 1 - (n - shared)
            order = np.lexsort((tok, count))[: single + 1]
            tok, count = tok[order], count[order].astype(float)
            pairs = sum(float(count[i]) * (len(count) - 1 - i) for i in range(len(count) - 1)) / 2 if len(count) <= 64 else np.inf
            for c, x in zip(schema.names, (rid, n, raw, tok.tobytes(), single, float(count[:single].sum()), pairs), strict=True):
                rows[c].append(x)
        return pa.table(rows, schema=schema)

    return ready


def _boundary(ready: DataFrame, num: int, den: int) -> int:
    """The size from which sets are heavy: the cheapest by the estimated work of every choice."""
    rows = ready.groupBy(F.least("n", F.lit(MOST_LIGHT)).alias("n")).agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2")).collect()
    c1, c2 = np.zeros(MOST_LIGHT + 1), np.zeros(MOST_LIGHT + 1)
    for r in rows:
        c1[r["n"]], c2[r["n"]] = r["c1"], r["c2"]
    light = np.r_[0, np.cumsum(c2)[:-1]]
    heavy = np.cumsum(c1[::-1])[::-1]
    costs = [light[b] + heavy[-(-num * b // den)] for b in range(MOST_LIGHT + 1)]
    return int(np.argmin(costs))


def _signatures(b: int, num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    from_size = -(-num * b // den)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rids, ns = [], [], []
            for rid, n, raw, single in zip(*(batch.column(c).to_pylist() for c in ("rid", "n", "first", "single")), strict=True):
                tok = np.frombuffer(raw, "<u8")
                out = [tok[:single]] if n >= from_size else []
                if n < b:
                    i, j = np.triu_indices(len(tok), 1)
                    with np.errstate(over="ignore"):
                        out.append(mix(tok[i] * U(0x9E3779B97F4A7C15) + mix(tok[j])))
                for x in out:
                    keys.append(x)
                    rids += [rid] * len(x)
                    ns += [n] * len(x)
            key = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(rids, pa.int64()), pa.array(ns, pa.int64())], names=["key", "rid", "n"])

    return emit


def _common(p: np.ndarray, q: np.ndarray) -> int:
    """How many values two sorted sets share; p is the smaller."""
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    return int((q[at] == p).sum())


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            out.append(_common(p, q) if len(p) <= len(q) else _common(q, p))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("na"), batch.column("nb"), pa.array(out, pa.int64())], names=["a", "b", "na", "nb", "both"])


def _verified(pairs: DataFrame, ready: DataFrame, label: str) -> DataFrame:
    """(a, b, na, nb, both) for each pair (a, b), by its whole sets."""
    x = ready.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("toks").alias("x"))
    y = ready.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("y"))
    wide = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "x", "y")
    return cut(wide.mapInArrow(_overlaps, "a long, b long, na long, nb long, both long"), label)


def _block_links(num: int, den: int) -> Callable[[pa.Table], pa.Table]:
    """Links that join the components of the documents of two blocks (or of one): a spanning forest, found by inverted lists of first shingles."""

    def run(table: pa.Table) -> pa.Table:
        docs = sorted(table.select(["rid", "n", "toks", "first", "single"]).to_pylist(), key=lambda d: (d["n"], d["rid"]))
        sets = [np.frombuffer(d["toks"], "<u8") for d in docs]
        up = list(range(len(docs)))
        lists: dict[int, list[int]] = {}
        a, b = [], []

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for i, d in enumerate(docs):
            met: set[int] = set()
            for t in np.frombuffer(d["first"], "<u8")[: d["single"]].tolist():
                here = lists.setdefault(t, [])
                met.update(here)
                here.append(i)
            for j in met:  # sizes rise, so docs[j] is the smaller
                small = docs[j]["n"]
                if den * small < num * d["n"] or root(i) == root(j):
                    continue
                both = _common(sets[j], sets[i])
                if den * both >= num * (small + d["n"] - both):
                    up[root(i)] = root(j)
                    a.append(d["rid"])
                    b.append(docs[j]["rid"])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs: set size, and the smallest id reachable by links.

    A-Z are lower-cased; words are runs of anything but space and 0x09-0x0D.  With fewer
    than k words the whole sequence is one shingle.  Defined results: null, empty or
    wordless texts have 0 shingles and link with nothing (component_id is their own id);
    a null id never is a smallest id unless a component has no other; a repeated row links
    with its copy; an empty table gives an empty result.  Columns other than the two named
    are not read, so their names cannot clash.
    """
    ship(docs.sparkSession)
    if not 2 * num > den >= num:
        raise ValueError("the threshold must be over one half and at most one")
    n = n_buckets(docs, text_col)
    keys = n_keys(docs, text_col, n)
    # two hashes: a row is known by 128 bits, and has one place in its bucket; buckets and places are the vertices
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumns({"rid": row_id("id", "text"), "rid2": row_id(F.lit(2), F.col("id"), F.col("text"))})
    thin = counted(own.select("rid", "rid2", "text")).select(bucket_of(F.col("rid"), n).alias("src"), "rid", "rid2", "text")

    first = cut(thin.groupBy("src").applyInArrow(_screen(k, num, den, keys), _FIRST), "screen")
    info = first.where("rid is not null").select("rid", "rid2", "v", "n", "d1", "d2")
    # written first: a join right above its aggregation could not split a set that many rows have
    rep = cut(info.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("v").alias("rep")), "reps")
    member = cut(info.join(rep, ["d1", "d2", "n"], "left").select("rid", "rid2", "v", "n", "rep"), "members")
    hits = shared_places(first.where("key is not null").select("src", "key", "data"), "shared")
    discard(first)
    copies = member.where("v <> rep").select(bucket_of(F.col("rid"), n).alias("src"), F.lit(None).cast("binary").alias("data"), F.col("v").alias("rid"))
    known = hits.withColumn("rid", F.lit(None).cast("long")).unionByName(copies)

    sets = cut(thin.groupBy("src").cogroup(known.groupBy("src")).applyInArrow(_collect(k, num, den, keys), _SETS), "sets")
    counts = gathered(sets.where("key is not null")).repartition("key").sortWithinPartitions("key").mapInArrow(_count, "src int, data binary")
    ready = cut(sets.where("rid is not null").select("src", "rid", "n", "toks").groupBy("src").cogroup(counts.groupBy("src")).applyInArrow(_prefixes(num, den, keys), _READY), "ready")
    discard(sets, hits)

    b = _boundary(ready, num, den)
    lists = cut(ready.select("rid", "n", "first", "single").mapInArrow(_signatures(b, num, den), "key long, rid long, n long"), "lists")
    # written first, as other tables below: a join right above its aggregation could not split a long list
    hubs = cut(lists.groupBy("key").agg(F.count("*").alias("c"), F.min_by("rid", F.struct("n", "rid")).alias("hub"), F.min("n").alias("hn")).where("c > 1").drop("c"), "hubs")
    rows = cut(lists.join(hubs, "key"), "rows")
    sizes = f"{den} * least(n, hn) >= {num} * greatest(n, hn)"
    star = _verified(rows.where("rid <> hub").where(sizes).select(F.col("hub").alias("a"), F.col("rid").alias("b")).distinct(), ready, "star")
    linked = f"{den} * both >= {num} * (na + nb - both)"
    part = components(star.where(linked).select("a", "b"), partial=True)

    # what is left: lists with documents of different components
    tagged = rows.join(cut(part.withColumnRenamed("vertex", "rid"), "part"), "rid", "left").withColumn("comp", F.coalesce("component", "rid")).drop("component")
    mixed = cut(tagged.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key"), "mixed")
    loose = cut(components(rows.join(mixed, "key", "left_semi").where("rid <> hub").select("hub", "rid")), "loose")
    sized = ready.select("rid", "n").join(loose.withColumnRenamed("vertex", "rid"), "rid")
    by_docs = F.least(F.ceil(F.col("m") / BLOCK), F.greatest(F.lit(MOST_BLOCKS), F.ceil(F.col("m") / LARGE_BLOCK)))
    blocks = cut(sized.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("shingles")).select("component", F.greatest(by_docs, F.ceil(F.col("shingles") / SHINGLES)).cast("int").alias("nb")), "sizes")
    placed = loose.join(blocks, "component").select("component", "nb", F.col("vertex").alias("rid"), F.pmod(F.xxhash64("vertex", F.lit(6)), F.col("nb")).cast("int").alias("block"))
    # each document goes to the tasks of its block, as a row of its own
    met = placed.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)"))).select("component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "rid")
    pairs = met.join(ready.select("rid", "n", "toks", "first", "single"), "rid")
    more = cut(pairs.groupBy("component", "lo", "hi").applyInArrow(_block_links(num, den), "a long, b long"), "more")
    links = star.where(linked).select("a", "b").union(more)
    whole = components(links)

    label = member.join(cut(whole.withColumnRenamed("vertex", "rep"), "whole"), "rep", "left").select("rid", "rid2", "n", F.coalesce("component", "rep").alias("comp"))
    placed = cut(own.select("id", "rid", "rid2").join(label, ["rid", "rid2"]), "placed")
    # written first: a join right above its aggregation could not split a large component
    least = cut(placed.where("comp is not null").groupBy("comp").agg(F.min("id").alias("low")), "least")
    return placed.join(least, "comp", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("low", "id").alias("component_id"))
