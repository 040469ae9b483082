"""Embedding near-dedup by cover-tree dual traversal.

Unit vectors of one label and length link when their cosine reaches the threshold, that is
when their chord is at most sqrt(2 - 2 t).  The levels, from above:

1. *Cells.*  Centres chosen farthest first from a sample; every vector goes to the nearest.
   There are more of them as a label grows, up to what the sample supports.
2. *Rings.*  Within a cell, vectors go by their distance from the centre, in steps of the
   chord.  Pairs of cells, then pairs of rings are dropped where the triangle inequality
   keeps them apart.  A ring is dealt to blocks of bounded size.
3. *Trees.*  Each block builds its cover tree once: nested levels with halving radii.

Two blocks that meet walk both trees at once: a pair of nodes is dropped when its centres
are farther apart than the chord and both radii, counted whole when every pair within must
link, and opened otherwise.  Tasks return counts and the links of a spanning forest for
each vector, never the pairs.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import _matrix, usable
from .components import components
from .infra import cut, discard, ship

#: Vectors of the sample that centres come from, and of it for a cell at least; vectors in a block; members of a leaf.
SAMPLE, FOR_A_CELL, BLOCK, LEAF = 32_768, 16, 2048, 48
_EPS = 1e-9


class CoverTree:
    """Nodes (centre, members, radius, children) over unit vectors; children's radii are at most half their parent's level."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.root = self._node(np.arange(len(x)), 0, 2.0)

    def _node(self, members: np.ndarray, centre: int, level: float) -> tuple:
        d = np.sqrt(np.maximum(((self.x[members] - self.x[centre]) ** 2).sum(1), 0))
        radius = float(d.max(initial=0.0))
        children = []
        if len(members) > LEAF and radius > 1e-6:
            half = min(level, radius) / 2
            left = np.ones(len(members), bool)
            at, dist = centre, d
            while True:
                take = left & (dist <= half)
                children.append((at, members[take]))
                left &= ~take
                if not left.any():
                    break
                at = int(members[np.argmax(left)])
                rest = np.flatnonzero(left)
                dist = np.full(len(members), np.inf)
                dist[rest] = np.sqrt(np.maximum(((self.x[members[rest]] - self.x[at]) ** 2).sum(1), 0))
            children = [self._node(m, c, half) for c, m in children]
            centres = np.array([c[0] for c in children])
            return centre, members, radius, children, centres, np.array([c[2] for c in children])
        return centre, members, radius, children, None, None


class _Links:
    """Counts of links and a spanning forest over the vectors of two blocks (places of the second follow the first's)."""

    def __init__(self, x: np.ndarray, threshold: float):
        self.x, self.norm, self.threshold = x, np.sqrt((x * x).sum(1)), threshold
        self.n = np.zeros(len(x), np.int64)
        self.up = np.arange(len(x))
        self.edges: list[tuple[int, int]] = []

    def _root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self._root(i), self._root(j)
        if a != b:
            self.up[a] = b
            self.edges.append((i, j))

    def compare(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """Exactly, all of a with all of b (of one leaf: each pair once)."""
        dot = self.x[a] @ self.x[b].T
        cos = dot / (self.norm[a][:, None] * self.norm[b][None])
        for i, j in np.argwhere(np.abs(cos - self.threshold) < 1e-12):  # too near to trust the order of a product's sums
            cos[i, j] = float(np.dot(self.x[a[i]], self.x[b[j]])) / float(np.sqrt(np.dot(self.x[a[i]], self.x[a[i]])) * np.sqrt(np.dot(self.x[b[j]], self.x[b[j]])))
        hit = cos >= self.threshold
        if same:
            hit = np.triu(hit, 1)
        self.n[a] += hit.sum(1)
        self.n[b] += hit.sum(0)
        for i, j in np.argwhere(hit).tolist():
            self.join(a[i], b[j])

    def all_of(self, a: np.ndarray) -> None:
        self.n[a] += len(a) - 1
        for i in a[1:]:
            self.join(i, a[0])

    def whole(self, a: np.ndarray, b: np.ndarray) -> None:
        self.n[a] += len(b)
        self.n[b] += len(a)
        for i in a:
            self.join(i, b[0])
        for j in b[1:]:
            self.join(a[0], j)


def walk(left: CoverTree, right: CoverTree | None, links: _Links, chord: float) -> None:
    """Both trees at once (right None: one tree with itself); places of right follow left's in links."""
    shift = 0 if right is None else len(left.x)
    u = left.x if right is None else np.concatenate((left.x, right.x))
    stack = [(left.root, (right or left).root, right is None)]
    while stack:
        a, b, same = stack.pop()
        if same:
            if 2 * a[2] <= chord - _EPS:
                links.all_of(a[1])
                continue
            if not a[3]:
                links.compare(a[1], a[1], True)
                continue
            kids, n = a[3], len(a[3])
            d = np.sqrt(np.maximum(2 - 2 * u[a[4]] @ u[a[4]].T, 0))
            near = np.triu(d - a[5][:, None] - a[5][None] <= chord + _EPS, 1)
            stack += [(kids[i], kids[i], True) for i in range(n) if len(kids[i][1]) > 1]
            stack += [(kids[i], kids[j], False) for i, j in np.argwhere(near).tolist()]
            continue
        d = float(np.sqrt(((u[a[0]] - u[b[0] + shift]) ** 2).sum()))
        if d - a[2] - b[2] > chord + _EPS:
            continue
        if d + a[2] + b[2] <= chord - _EPS:
            links.whole(a[1], b[1] + shift)
        elif not a[3] and not b[3]:
            links.compare(a[1], b[1] + shift, False)
        elif a[3] and b[3]:
            d = np.sqrt(np.maximum(2 - 2 * u[a[4]] @ u[b[4] + shift].T, 0))
            near = d - a[5][:, None] - b[5][None] <= chord + _EPS
            stack += [(a[3][i], b[3][j], False) for i, j in np.argwhere(near).tolist()]
        elif a[3]:
            stack += [(c, b, False) for c in a[3]]
        else:
            stack += [(a, c, False) for c in b[3]]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _plant(table: pa.Table) -> pa.Table:
    """A block as one row: its row ids, vectors and cover tree."""
    table = table.sort_by("rid")
    x = _matrix(table["vec"])
    block = pickle.dumps((table["rid"].to_numpy(), x, CoverTree(_unit(x)).root), protocol=5)
    keys = {c: table[c].slice(0, 1) for c in ("grp", "cell", "ring", "part")}
    return pa.table({**keys, "block": pa.array([block], pa.binary())})


def _meet(threshold: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    chord = float(np.sqrt(2 - 2 * threshold))

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        blocks = [pickle.loads(b) for t in (one, other) for b in t["block"].to_pylist()]  # noqa: S301 (written by _plant)
        x, ids = (np.concatenate([b[i] for b in blocks]) for i in (1, 0))
        trees = []
        for _, m, root in blocks:
            tree = CoverTree.__new__(CoverTree)
            tree.x, tree.root = _unit(m), root
            trees.append(tree)
        links = _Links(x, threshold)
        walk(trees[0], trees[1] if len(trees) > 1 else None, links, chord)
        hit = np.flatnonzero(links.n)
        e = np.array(links.edges, np.int64).reshape(-1, 2)
        return pa.table({
            "rid": pa.array(np.concatenate((ids[hit], ids[e[:, 0]])), pa.int64()),
            "n": pa.array(np.concatenate((links.n[hit], np.zeros(len(e), np.int64))), pa.int64()),
            "other": pa.array([None] * len(hit) + ids[e[:, 1]].tolist(), pa.int64()),
        })

    return run


def _centres(sample: pa.Table, total: int) -> dict[str, np.ndarray]:
    """Centres of each group of the sample, farthest first: a cover whose radius falls."""
    centres, groups = {}, np.array(sample["grp"].to_pylist(), object)
    for g in sorted(set(groups.tolist())):
        at = np.flatnonzero(groups == g)
        cells = int(np.clip(total * len(at) / len(groups) // BLOCK, 1, max(1, len(at) // FOR_A_CELL)))
        m = _unit(_matrix(sample["vec"].take(pa.array(at))))
        chosen, d = [0], np.sqrt(((m - m[0]) ** 2).sum(1))
        while len(chosen) < cells and d.max() > 1e-9:
            chosen.append(int(np.argmax(d)))
            d = np.minimum(d, np.sqrt(((m - m[chosen[-1]]) ** 2).sum(1)))
        centres[g] = m[chosen]
    return centres


def near_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row: rows of its label linked directly, the smallest id reachable, and whether it is that one.

    Defined results: vectors that are null, zero or hold null or non-finite components, and
    those with a null label, link with nothing, nor do vectors of different lengths; a
    repeated row is another vector, and links with its copy; a null id links with nothing,
    its component is null and it is not kept; other columns are not read; an empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    named = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vec_col}`").alias("vec"))
    fit = usable(F.col("vec")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # written, so that a row keeps its number when a task is run again
    one = cut(named.select("vec_id", F.monotonically_increasing_id().alias("rid"), F.when(fit, F.concat(F.size("vec").cast("string"), F.lit(":"), "label")).alias("grp"), F.when(fit, F.col("vec")).alias("vec")), "vectors")
    rows = one.where("grp is not null").select("rid", "grp", "vec")
    sample = rows.orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE).toArrow()
    centres = _centres(sample, rows.count()) if sample.num_rows else {}
    held = spark.sparkContext.broadcast(centres)  # at most SAMPLE / FOR_A_CELL vectors and one a group of the sample
    chord = float(np.sqrt(2 - 2 * threshold))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[int]] = {}
            for i, g in enumerate(b.column("grp").to_pylist()):
                by.setdefault(g, []).append(i)
            cell, dist = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for g, at in by.items():
                c = held.value.get(g)
                if c is not None:  # a group that the sample has no row of is one cell without a centre
                    d = np.sqrt(np.maximum(2 - 2 * _unit(_matrix(b.column("vec").take(pa.array(at)))) @ c.T, 0))
                    cell[at], dist[at] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(dist), pa.array((dist / chord).astype(np.int32))], names=["rid", "grp", "vec", "cell", "dist", "ring"])

    vec_type = one.schema["vec"].dataType.simpleString()
    dealt = cut(rows.mapInArrow(assign, f"rid long, grp string, vec {vec_type}, cell int, dist double, ring int"), "dealt")
    rings = cut(dealt.groupBy("grp", "cell", "ring").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("np"), F.min("dist").alias("lo"), F.max("dist").alias("hi")), "rings")
    placed = dealt.join(rings.select("grp", "cell", "ring", "np"), ["grp", "cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("rid", F.lit(8)), F.col("np")).cast("int"))
    keys = ["grp", "cell", "ring", "part"]
    blocks = cut(placed.select(*keys, "rid", "vec").groupBy(*keys).applyInArrow(_plant, "grp string, cell int, ring int, part int, block binary"), "blocks")

    # cells of a group near enough to each other, rings of two such cells, and their blocks
    pairs = []
    for g, c in centres.items():
        apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))
        i, j = np.triu_indices(len(c))
        pairs.append(pa.table({"grp": pa.array([g] * len(i)), "ca": pa.array(i.astype(np.int32)), "cb": pa.array(j.astype(np.int32)), "apart": pa.array(apart[i, j])}))
    cells = spark.createDataFrame(pa.concat_tables(pairs)) if pairs else spark.createDataFrame([], "grp string, ca int, cb int, apart double")
    lone = rings.join(cells.select("grp").distinct(), "grp", "left_anti").select("grp", F.col("cell").alias("ca"), F.col("cell").alias("cb"), F.lit(0.0).alias("apart")).distinct()
    side = lambda s: rings.select("grp", F.col("cell").alias(f"c{s}"), F.col("ring").alias(f"r{s}"), F.col("np").alias(f"n{s}"), F.col("lo").alias(f"lo{s}"), F.col("hi").alias(f"hi{s}"))
    gap = F.greatest(F.col("apart") - F.col("hia") - F.col("hib"), F.col("loa") - F.col("apart") - F.col("hib"), F.col("lob") - F.col("apart") - F.col("hia"))
    near = cells.unionByName(lone).join(side("a"), ["grp", "ca"]).join(side("b"), ["grp", "cb"]).where(gap <= chord + 1e-6).where("ca < cb or ra <= rb")
    same = (F.col("ca") == F.col("cb")) & (F.col("ra") == F.col("rb"))
    some = near.withColumn("pa", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("pb", F.explode(F.sequence(F.when(same, F.col("pa")).otherwise(0), F.col("nb") - 1)))
    key = ["grp", "ca", "ra", "pa", "cb", "rb", "pb"]
    meets = cut(some.select(*key), "meets")
    a = meets.join(blocks.withColumnsRenamed({"cell": "ca", "ring": "ra", "part": "pa"}), ["grp", "ca", "ra", "pa"]).select(*key, "block")
    b = meets.where("ca <> cb or ra <> rb or pa <> pb").join(blocks.withColumnsRenamed({"cell": "cb", "ring": "rb", "part": "pb"}), ["grp", "cb", "rb", "pb"]).select(*[F.col(c).alias(c) for c in (*key, "block")])
    found = cut(a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(_meet(threshold), "rid long, n long, other long"), "links")
    discard(dealt, blocks)

    counts = found.groupBy("rid").agg(F.sum("n").alias("n_links"))
    label = cut(components(found.where("other is not null").select("rid", "other")).withColumnRenamed("vertex", "rid"), "labels")
    # written first: a join right above its aggregation could not split a large component
    least = cut(label.join(one.select("rid", "vec_id"), "rid").groupBy("component").agg(F.min("vec_id").alias("low")), "least")
    out = one.select("rid", "vec_id").join(counts, "rid", "left").join(label, "rid", "left").join(least, "component", "left")
    group = F.coalesce("low", "vec_id")
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), group.alias("component_id"), F.coalesce(group == F.col("vec_id"), F.lit(False)).alias("kept"))
