"""Substring dedup by difference-cover anchors.

A window is `window` consecutive words of one document.  A word goes when some
window over it has a word sequence that starts at another place too.

Hashing every window would move one record for each word of the corpus.  Instead
only positions whose residue modulo `period` lies in a difference cover D send a
fingerprint, of the `window - period + 1` words from there.  For any two places i, j
some shift d < period puts i + d and j + d both on D, so equal windows always share an
aligned anchor.  A second pass extends: windows over a shared anchor, and no others,
are compared by a longer fingerprint.  Places are grouped, never paired.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .infra import as_bytes, blobs, bucket_of, by_key, counted, cut, gathered, in_order, joined, n_buckets, n_keys, row_id, ship
from .wordhash import Words

#: Perfect difference covers: period -> residues whose differences give every residue. Fixed values.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}

#: A fingerprint on its way: 48 + 32 bits (16 more and the bucket's are implied), its place in the bucket, whether it came twice there.
_REC = np.dtype([("a", "<u4"), ("b", "<u2"), ("c", "<u4"), ("at", "<u4"), ("twice", "u1")])
_BLOB = "src int, key int, data binary"
_HITS = "src int, data binary"


def period_for(window: int) -> int:
    """The largest period that leaves anchors of at least half a window less three words (one word at least)."""
    return max(p for p in COVERS if p == 1 or window - p + 1 >= max(1, window // 2 - 3))


def _send(src: int, h1: np.ndarray, h2: np.ndarray, at: np.ndarray, n_keys: int, repeated: np.ndarray | None = None) -> pa.Table:
    """One record for each distinct fingerprint; the rest of its places are known to repeat, and so are repeated ones."""
    order = np.lexsort((h2, h1))
    h1, h2, at = h1[order], h2[order], at[order]
    new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])] if len(h1) else np.zeros(0, bool)
    size = np.diff(np.r_[np.flatnonzero(new), len(h1)])
    if repeated is not None and len(h1):
        size = size + np.maximum.reduceat(repeated[order].astype(np.int64), np.flatnonzero(new))
    rec = np.zeros(int(new.sum()), dtype=_REC)
    rec["a"], rec["b"], rec["c"] = h1[new] >> np.uint64(32), (h1[new] >> np.uint64(16)).astype(np.uint16), h2[new] >> np.uint64(32)
    rec["at"], rec["twice"] = at[new], size > 1
    key, data = blobs((h1[new] & np.uint64(n_keys - 1)).astype(np.int64), rec)
    sent = pa.table({"src": pa.array(np.full(len(key), src, np.int32)), "key": pa.array(key), "data": data})
    rest = at[~new].astype("<u4")  # these go home at once, under no key
    if len(rest):
        home = pa.table({"src": pa.array([src], pa.int32()), "key": pa.array([-1 - src], pa.int32()), "data": pa.array([rest.tobytes()], pa.binary())})
        sent = pa.concat_tables([sent, home])
    return sent


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per key bucket (rows come sorted by it): the places of fingerprints that came more than once, by bucket of origin."""
    for key, src, data in by_key(batches, _REC.itemsize):
        if key < 0:  # places that go home at once
            yield pa.RecordBatch.from_arrays([pa.array([-1 - key], pa.int32()), pa.array([data], pa.binary())], names=["src", "data"])
            continue
        rec = np.frombuffer(data, dtype=_REC)
        h = (rec["a"].astype(np.uint64) << np.uint64(16)) | rec["b"]
        order = np.lexsort((rec["c"], h))
        h, c = h[order], rec["c"][order]
        new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
        group = np.cumsum(new) - 1
        shared = np.bincount(group)[group] > 1
        shared |= np.bincount(group, weights=rec["twice"][order])[group] > 0
        order = order[shared]
        home, places = blobs(src[order], np.ascontiguousarray(rec["at"][order]).astype("<u4"))
        yield pa.RecordBatch.from_arrays([pa.array(home), places], names=["src", "data"])


def shared_places(sent: DataFrame, label: str) -> DataFrame:
    """(src, data): places whose fingerprint occurs more than once anywhere, written out."""
    return cut(gathered(sent).repartition("key").sortWithinPartitions("key").mapInArrow(_meet, _HITS), label)


def _copied(table: pa.Table) -> np.ndarray:
    return table["copies"].to_numpy() > 1


def _anchors(window: int, period: int, n_keys: int) -> Callable[[pa.Table], pa.Table]:
    size, cover = window - period + 1, np.zeros(period, bool)
    cover[list(COVERS[period])] = True

    def send(table: pa.Table) -> pa.Table:
        table = in_order(table)
        w = Words(as_bytes(table["text"]))
        h1, ok = w.windows(size), w.inside(size)
        n = len(h1)
        place = np.arange(n) - w.first[w.doc[:n]]
        at = np.flatnonzero(ok & cover[place % period] & (w.counts[w.doc[:n]] >= window))
        return _send(table["src"][0].as_py(), h1[at], np.zeros(len(at), np.uint64), at, n_keys, _copied(table)[w.doc[at]])

    return send


def _extend(window: int, period: int, n_keys: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    size = window - period + 1

    def send(docs: pa.Table, hits: pa.Table) -> pa.Table:
        at = joined(hits["data"], np.dtype("<u4")).astype(np.int64)
        if not len(at) or not docs.num_rows:
            return _send(0, *[np.zeros(0, np.uint64)] * 2, np.zeros(0, np.int64), n_keys)
        docs = in_order(docs)
        w = Words(as_bytes(docs["text"]))
        delta = np.zeros(len(w.hash) + 2, np.int64)  # windows from at + size - window to at hold the anchor
        np.add.at(delta, np.maximum(at + size - window, 0), 1)
        np.add.at(delta, at + 1, -1)
        h1, ok = w.windows(window), w.inside(window)
        start = np.flatnonzero((np.cumsum(delta)[: len(h1)] > 0) & ok)
        return _send(docs["src"][0].as_py(), h1[start], w.windows(window, "win2")[start], start, n_keys, _copied(docs)[w.doc[start]])

    return send


def _finish(window: int, extra: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def keep(docs: pa.Table, hits: pa.Table) -> pa.Table:
        docs = in_order(docs)
        texts = as_bytes(docs["text"])
        w = Words(texts)
        at = joined(hits["data"], np.dtype("<u4")).astype(np.int64)
        delta = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(delta, at, 1)
        np.add.at(delta, at + window, -1)
        gone = np.cumsum(delta)[:-1] > 0
        removed = np.bincount(w.doc[gone], minlength=len(texts))
        kept = []
        for i, text in enumerate(texts):
            words = text.split()  # bytes.split cuts at the same six bytes
            kept.append(b" ".join(compress(words, ~gone[w.first[i] : w.first[i + 1]]) if removed[i] else words))
        out = {c: docs[c] for c in extra}
        out |= {"n_words": pa.array(w.counts.astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}
        return pa.table(out)

    return keep


def substring_dedup(docs: DataFrame, text_col: str = "text", window: int = 35) -> DataFrame:
    """docs with n_words, n_removed and kept_text (kept words joined by one space).

    Words are runs of anything but space and 0x09-0x0D, compared unchanged.  Windows are
    judged on the input.  Defined results: a null or empty text has no words; a repeated
    row counts as another occurrence, so both lose what they share; rows come back once
    each, all their columns kept; result columns replace input columns of the same name.
    An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    period = period_for(window)
    clash = {"n_words", "n_removed", "kept_text"}
    keep = [c for c in docs.columns if c not in clash]
    n = n_buckets(docs, text_col)
    # columns travel under safe names, so that none can clash with ours
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    text = F.col(f"c{keep.index(text_col)}")
    whole = [f"c{i}" for i in range(len(keep))]
    keys = n_keys(docs, text_col, n)
    hashed = [F.to_json(F.struct(c)) if _nested(named, c) else F.col(c) for c in whole]
    # two hashes: a row is known by 128 bits, and has one place in its bucket
    own = counted(named.withColumn("rid2", row_id(F.lit(2), *hashed)).withColumn("rid", row_id(*hashed))).withColumn("src", bucket_of(F.col("rid"), n))
    thin = own.select("src", "rid", "rid2", "copies", text.alias("text"))
    hits = shared_places(thin.groupBy("src").applyInArrow(_anchors(window, period, keys), _BLOB), "anchors")
    sent = thin.groupBy("src").cogroup(hits.groupBy("src")).applyInArrow(_extend(window, period, keys), _BLOB)
    hits = shared_places(sent, "windows")
    final = own.withColumn("text", text)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema.fields)
    out = final.groupBy("src").cogroup(hits.groupBy("src")).applyInArrow(_finish(window, [*whole, "copies"]), f"{schema}, copies long, n_words long, n_removed long, kept_text string")
    out = out.withColumn("copies", F.explode(F.expr("array_repeat(0, cast(copies as int))")))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_removed", "kept_text")


def _nested(df: DataFrame, c: str) -> bool:
    """Whether values of c hold others: maps cannot be hashed, and a hash passes over nulls within the others."""
    return df.schema[c].dataType.typeName() in ("map", "variant", "struct", "array")
