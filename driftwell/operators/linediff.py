"""Line differences of pairs of texts: what is stale, as hunks that rebuild the new text.

The shortest edit script by Myers' O(ND) search in linear space: forward and backward
searches meet in a middle snake, and the two halves are solved alike.  The diagonals of a
step are advanced together with numpy.  Common beginnings and ends, and lines that only one
side has, are set aside first: they cannot change what is shortest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning, looked at in stretches that double."""
    n, done, size = min(len(a), len(b)), 0, 64
    while done < n:
        end = min(n, done + size)
        differ = np.flatnonzero(a[done:end] != b[done:end])
        if len(differ):
            return done + int(differ[0])
        done, size = end, size * 2
    return n


def _step(v: np.ndarray, off: int, d: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One more edit on all diagonals: (diagonals, where their snakes begin, where they end); -1: outside."""
    n, m = len(a), len(b)
    k = np.arange(-(d - 2 * max(0, d - m)), d - 2 * max(0, d - n) + 1, 2)
    if d:
        left, right = v[k - 1 + off], v[k + 1 + off]
        x = np.maximum(np.where((left >= 0) & (left < n), left + 1, -1), np.where((right >= 0) & (right - k <= m), right, -1))
    else:
        x = np.zeros(1, np.int64)
    start = x.copy()
    live = np.flatnonzero(x >= 0)
    for _ in range(8):
        live = live[(x[live] < n) & (x[live] - k[live] < m)]
        live = live[a[x[live]] == b[x[live] - k[live]]]
        if not len(live):
            break
        x[live] += 1
    for i in live:  # the few long snakes
        x[i] += _common(a[x[i] :], b[x[i] - k[i] :])
    v[k + off] = x
    return k, start, x


def _middle(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(x, y, length) of the snake in the middle of a shortest script."""
    n, m = len(a), len(b)
    delta, off = n - m, m + 2
    forth, back = np.full(n + m + 5, -1, np.int64), np.full(n + m + 5, -1, np.int64)
    ra, rb = a[::-1], b[::-1]

    def met(k: np.ndarray, x: np.ndarray, other: np.ndarray, d: int) -> int | None:
        kr = delta - k
        ok = (x >= 0) & (kr >= -m) & (kr <= n) & (np.abs(kr) <= d)
        far = np.where(ok, other[np.clip(kr, -m - 1, n + 1) + off], -1)
        hit = np.flatnonzero((far >= 0) & (x + far >= n))
        return int(hit[0]) if len(hit) else None

    for d in range((n + m + 1) // 2 + 1):
        k, start, x = _step(forth, off, d, a, b)
        if delta & 1 and (i := met(k, x, back, d - 1)) is not None:
            return int(start[i]), int(start[i] - k[i]), int(x[i] - start[i])
        k, start, x = _step(back, off, d, ra, rb)
        if not delta & 1 and (i := met(k, x, forth, d)) is not None:
            return n - int(x[i]), m - int(x[i] - k[i]), int(x[i] - start[i])
    raise AssertionError("searches did not meet")


def matches(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of the stretches that a shortest script keeps, in order."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        n = _common(a[i:i_end], b[j:j_end])
        if n:
            found.append((i, j, n))
            i, j = i + n, j + n
        n = _common(a[i:i_end][::-1], b[j:j_end][::-1])
        if n:
            i_end, j_end = i_end - n, j_end - n
            found.append((i_end, j_end, n))
        if i < i_end and j < j_end:
            x, y, n = _middle(a[i:i_end], b[j:j_end])
            if n:
                found.append((i + x, j + y, n))
            todo += [(i, i + x, j, j + y), (i + x + n, i_end, j + y + n, j_end)]
    return sorted(found)


def hunks(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """(old_from, old_count, new_from, new_count), places from 0, of the stretches that differ."""
    codes: dict[str, int] = {}
    a, b = (np.fromiter((codes.setdefault(x, len(codes)) for x in side), np.int64, len(side)) for side in (old, new))
    both = np.zeros(len(codes), np.int8)
    both[a] |= 1
    both[b] |= 2
    at, bt = np.flatnonzero(both[a] == 3), np.flatnonzero(both[b] == 3)  # lines of one side only match nothing
    keep_a, keep_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j, n in matches(a[at], b[bt]):
        keep_a.append(at[i : i + n])
        keep_b.append(bt[j : j + n])
    x, y = np.r_[-1, np.concatenate(keep_a), len(a)], np.r_[-1, np.concatenate(keep_b), len(b)]
    gap = np.flatnonzero((np.diff(x) > 1) | (np.diff(y) > 1))
    return [(int(x[i]) + 1, int(x[i + 1] - x[i]) - 1, int(y[i]) + 1, int(y[i + 1] - y[i]) - 1) for i in gap]


_HUNK = "old_from long, old_count long, new_from long, new_count long, removed array<string>, added array<string>"


def line_hunks(df: DataFrame, old: str, new: str) -> DataFrame:
    """df's other columns and a row for each hunk: (old_from, old_count, new_from, new_count, removed, added), places from 1.

    Lines are what stands between newlines, so an end without a newline is a difference.
    Texts that are equal have no row; a null text is empty (one empty line).  Time grows with
    lines times differences of a pair, memory with its lines; a pair is one task's."""
    rest = [c for c in df.columns if c not in (old, new)]
    schema = df.select(*rest).schema
    for f in df.sparkSession.createDataFrame([], _HUNK).schema:
        schema = schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], []
            for i, (x, y) in enumerate(zip(b.column(len(rest)).to_pylist(), b.column(len(rest) + 1).to_pylist(), strict=True)):
                left, right = (x or "").split("\n"), (y or "").split("\n")
                for of, on, nf, nn in hunks(left, right) if x != y else ():
                    rows.append(i)
                    out.append((of + 1, on, nf + 1, nn, left[of : of + on], right[nf : nf + nn]))
            kept = b.select(rest).take(pa.array(rows, pa.int32()))
            made = [list(c) for c in zip(*out, strict=True)] or [[]] * 6
            kinds = [*[pa.int64()] * 4, *[pa.list_(pa.string())] * 2]
            yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, made, kinds)], names=[*rest, *(f.split()[0] for f in _HUNK.split(", "))])

    return df.select(*rest, old, new).mapInArrow(run, schema)


def with_hunks(df: DataFrame, old: str, new: str, name: str = "hunks") -> DataFrame:
    """df's other columns and its hunks as one array by their order, empty where the texts are equal: a row stays a row, whichever others are alike, and nothing is joined."""
    rest = [c for c in df.columns if c not in (old, new)]
    kind = pa.list_(pa.struct([*((f, pa.int64()) for f in ("old_from", "old_count", "new_from", "new_count")), *((f, pa.list_(pa.string())) for f in ("removed", "added"))]))
    schema = df.select(*rest).schema.add(name, ArrayType(df.sparkSession.createDataFrame([], _HUNK).schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y in zip(b.column(len(rest)).to_pylist(), b.column(len(rest) + 1).to_pylist(), strict=True):
                left, right = (x or "").split("\n"), (y or "").split("\n")
                out.append([{"old_from": of + 1, "old_count": on, "new_from": nf + 1, "new_count": nn, "removed": left[of : of + on], "added": right[nf : nf + nn]} for of, on, nf, nn in (hunks(left, right) if x != y else ())])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(out, kind)], names=[*rest, name])

    return df.select(*rest, old, new).mapInArrow(run, schema)


def patched(text: Column, found: Column) -> Column:
    """A text with its hunks put in: found is an array of structs (old_from, old_count, added), in any order; null or empty leaves the text."""

    @F.pandas_udf("string")
    def run(t, f):
        def one(text, items):
            lines, out, at = (text or "").split("\n"), [], 0
            for h in sorted(items if items is not None else [], key=lambda h: h["old_from"]):
                out += [*lines[at : h["old_from"] - 1], *h["added"]]
                at = h["old_from"] - 1 + h["old_count"]
            return "\n".join(out + lines[at:])

        return t.combine(f, one)

    return run(text, found)
