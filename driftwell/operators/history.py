"""Reachability in a history of commits, without walking it commit by commit.

The history is laid out in chains: each commit continues the chain of its first parent, if
it is the child chosen for that, and its generation is its place in the chain from the oldest
on; places are found by pointer doubling between stops, and those of the stops likewise.  What can be reached in a chain from a commit of it
is the commit's place and all below, so what is visited is one number a chain, however many
commits it has.  A frontier round follows the edges between chains that start in what
was reached since the last round; merges that lead to what is visited lead nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from driftwell.sources.shared import discarded, written

#: Rounds of doubling at most; a history that needs more has a circle.
_ROUNDS = 48
#: Links that one task walks at most (some 100 bytes each); and how far apart stops are among more.
_WALK, _APART = 1 << 20, 32


def _walked(links: DataFrame) -> DataFrame:
    """_placed by one task, which holds all links; chain is null where they lead into a circle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, pa_schema)
        ids = rows["id"].combine_chunks()
        at = pc.index_in(rows["to"].combine_chunks(), value_set=ids, skip_nulls=True)
        root = at.is_null().to_numpy(zero_copy_only=False)
        to = np.where(root, np.arange(len(ids)), at.fill_null(0).to_numpy())
        far = np.where(root, 0, rows["step"].to_numpy())
        for _ in range(len(ids).bit_length()):
            if root[to].all():
                break
            to, far = to[to], far + far[to]
        chain = ids.take(pa.array(np.where(root[to], to, -1), pa.int64(), mask=~root[to]))
        table = pa.Table.from_arrays([ids, chain, pa.array(far, pa.int64())], names=["id", "chain", "place"])
        yield from table.to_batches(max_chunksize=1 << 16)

    pa_schema = to_arrow_schema(links.schema)
    kind = links.schema["id"].dataType
    schema = StructType([StructField("id", kind), StructField("chain", kind), StructField("place", LongType())])
    return written(links.coalesce(1).mapInArrow(run, schema), "walked")


def _placed(links: DataFrame, level: int = 0) -> DataFrame:
    """(id, chain, place) of links (id, to, step), written: the first of the list that an id lies in (to is null there), and the steps from there.

    Up to _WALK links are walked by one task.  Of more, each goes by doubling to the next
    stop, one of _APART by hash, or to its list's first; then the stops are such a list."""
    if links.count() <= _WALK:
        out = _walked(links)
        if not out.where("chain is null").isEmpty():
            raise ValueError("the history has a circle")
        return out
    stop = lambda c: F.pmod(F.xxhash64(F.lit(level), c), F.lit(_APART)) == 0
    begun = links.select("id", F.coalesce("to", "id").alias("chain"), F.col("step").alias("place"), (F.col("to").isNotNull() & ~F.coalesce(stop(F.col("to")), F.lit(True))).alias("open"))
    now, ends = written(begun, "places"), []
    for _ in range(_ROUNDS):
        ends.append(now)
        if now.where("open").isEmpty():
            break
        up = _all(ends).where("not open").unionByName(now.where("open"))
        up = up.select(F.col("id").alias("chain"), F.col("chain").alias("next"), F.col("place").alias("far"), F.col("open").alias("still"))
        moved = now.where("open").join(up, "chain").select("id", F.col("next").alias("chain"), (F.col("place") + F.col("far")).alias("place"), F.col("still").alias("open"))
        now = written(moved, "places")
    else:
        raise ValueError("the history has a circle")
    reached = _all(ends).where("not open").withColumn("on", (F.col("chain") != F.col("id")) & stop(F.col("chain"))).drop("open")
    stops = written(reached.where(stop(F.col("id"))).withColumn("to", F.when(F.col("on"), F.col("chain"))), "stops")
    lists = _placed(written(stops.select("id", "to", F.when(F.col("on"), F.col("place")).otherwise(0).cast("long").alias("step")), "links"), level + 1)
    first = stops.where("to is null").select(F.col("id").alias("chain"), F.col("chain").alias("begin"), F.col("place").alias("before"))
    whole = lists.join(first, "chain").select(F.col("id").alias("chain"), "begin", (F.col("place") + F.col("before")).alias("before"))
    behind = reached.where("on").join(whole, "chain").select("id", F.col("begin").alias("chain"), (F.col("place") + F.col("before")).alias("place"))
    out = written(reached.where("not on").drop("on").unionByName(behind), "places")
    discarded(*ends, stops)
    return out


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def laid_out(commits: DataFrame, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((id, chain, place), (chain, place, to_chain, to_place)) of commits (id, parent): where each commit lies, and the edges between chains.

    A commit's first parent is that with the least nth, if commits has that column, else (and
    of equal ones) the largest; of its children that have it as first parent the largest
    continues its chain.  Any choice gives the same ancestors; chains as long as lines of
    development make few rounds.

    more: (id) of commits to be laid out even if nothing is known of them.  Repeated rows
    count once, null parents are none, a parent without a row of its own is a commit without
    parents."""
    nth = F.min(F.coalesce("nth", F.lit(0))) if "nth" in commits.columns else F.lit(0)
    edges = written(commits.where("id is not null and parent is not null").groupBy("id", "parent").agg(nth.alias("nth")), "edges")
    ids = commits.select("id").unionByName(edges.select(F.col("parent").alias("id")))
    ids = (ids if more is None else ids.unionByName(more.select("id"))).where("id is not null").distinct()
    first = edges.groupBy("id").agg(F.max_by("parent", F.struct(-F.col("nth"), "parent")).alias("parent"))
    link = written(first.groupBy("parent").agg(F.max("id").alias("id")).select("id", F.col("parent").alias("to")), "links")
    links = written(ids.join(link, "id", "left").select("id", "to", F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("long").alias("step")), "places")
    places = _placed(links)
    between = edges.join(link.withColumnRenamed("to", "parent"), ["id", "parent"], "left_anti")
    end = places.select(F.col("id").alias("parent"), F.col("chain").alias("to_chain"), F.col("place").alias("to_place"))
    crossing = written(between.join(places, "id").join(end, "parent").select("chain", "place", "to_chain", "to_place"), "crossing")
    return places, crossing


def reached(starts: DataFrame, places: DataFrame, crossing: DataFrame) -> DataFrame:
    """(key, chain, place): the highest place that each key reaches in each chain, and with it all places below; starts: (key, id)."""
    first = starts.join(places, "id").groupBy("key", "chain").agg(F.max("place").alias("place"))
    front = written(first.withColumn("old", F.lit(-1).cast("long")), "front")
    seen = front.select("key", "chain", "place")
    while True:
        step = front.join(crossing.withColumnRenamed("place", "at"), "chain").where("at <= place and at > old")
        found = step.groupBy("key", F.col("to_chain").alias("chain")).agg(F.max("to_place").alias("new"))
        more = found.join(seen, ["key", "chain"], "left").where("place is null or new > place")
        ahead = written(more.select("key", "chain", F.col("new").alias("place"), F.coalesce("place", F.lit(-1)).alias("old")), "front")
        if ahead.isEmpty():
            return seen
        seen = written(seen.unionByName(ahead.select("key", "chain", "place")).groupBy("key", "chain").agg(F.max("place").alias("place")), "seen")
        front = ahead


def ancestors(starts: DataFrame, commits: DataFrame) -> DataFrame:
    """(key, id): each commit that is reached from a key's starts, these included."""
    places, crossing = laid_out(commits, starts)
    top = reached(starts, places, crossing).withColumnRenamed("place", "top")
    return top.join(places, "chain").where("place <= top").select("key", "id")


def drift(checkouts: DataFrame, commits: DataFrame) -> DataFrame:
    """checkouts (name, head, other) against commits (id, parent): in sync, behind by n, diverged, or unknown.

    behind: head is an ancestor of other; n counts the commits that other has and head has
    not.  unknown: one of them is null."""
    sides = [checkouts.select("name", F.lit(s).alias("side"), F.col(s).alias("id")).where("id is not null") for s in ("head", "other")]
    starts = sides[0].unionByName(sides[1]).select(F.struct("name", "side").alias("key"), "id")
    places, crossing = laid_out(commits, starts)
    top = written(reached(starts, places, crossing).select("key.name", "key.side", "chain", "place"), "reached")
    counts = top.groupBy("name").pivot("side", ["head", "other"]).agg(F.sum(F.col("place") + 1))
    within = sides[0].join(places, "id").select("name", "chain", F.col("place").alias("at")).join(top.where("side = 'other'"), ["name", "chain"]).where("at <= place").select("name", F.lit(True).alias("ancestor")).distinct()
    n = counts.select("name", (F.col("other") - F.coalesce("head", F.lit(0))).alias("n"))
    state = F.when(F.col("head").isNull() | F.col("other").isNull(), "unknown").when(F.col("head") == F.col("other"), "in sync").when(F.col("ancestor"), "behind").otherwise("diverged")
    out = checkouts.join(within, "name", "left").join(n, "name", "left").withColumn("state", state)
    return out.select("name", "state", F.when(F.col("state") == "behind", F.col("n")).alias("n_behind"))
