"""Registries of checks over texts and of rendered blocks, each run as one job.

All checks of a registry share one scan: what they ask of a whole text is computed before
the text is split, what they ask of lines is one array filter on each line, and counts for a
text are combined before the one exchange.  All blocks of a registry are held against the
files in one join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions.text import computed
from driftwell.operators import documents, linediff, regions


@dataclass(frozen=True)
class Check:
    """One check. scope: line (each line that is wrong is a problem), text (a text that is wrong is one) or count (a text with fewer than `least` or more than `most` such lines is one)."""

    number: int
    name: str
    severity: str
    scope: str
    wrong: Callable[[Column], Column]
    least: int = 0
    most: int | None = None


class Checks:
    """A registry of checks by number and name."""

    def __init__(self):
        self._all: dict[int, Check] = {}

    def add(self, check: Check) -> Check:
        """Refuses a number or a name that is taken, and an unknown scope."""
        if check.number in self._all or any(c.name == check.name for c in self._all.values()):
            raise ValueError(f"check {check.number} ({check.name}) is registered already")
        if check.scope not in ("line", "text", "count"):
            raise ValueError(f"check {check.number}: unknown scope {check.scope}")
        self._all[check.number] = check
        return check

    def selected(self, numbers: Sequence[int] | None = None) -> list[Check]:
        """The checks of these numbers (null: all), by number; none at all is an error, since nothing would be checked, and so is an unknown number."""
        unknown = set(numbers or ()) - set(self._all)
        out = [c for n, c in sorted(self._all.items()) if numbers is None or n in numbers]
        if unknown or not out:
            raise ValueError(f"no such checks: {sorted(unknown)}" if unknown else "no check is selected")
        return out

    def run(self, texts: DataFrame, key: str, text: str = "text", numbers: Sequence[int] | None = None) -> DataFrame:
        """(key, number, name, severity, line_no, n): the problems of all selected checks over (key, text), in one scan and one exchange.

        line_no is null for problems of a whole text; n is how many lines counted (1 for
        others).  Lines are what stands between newlines, without CR; the empty piece after
        a last newline is none, a null or empty text has no lines.  Rows of one key are one
        text."""
        chosen = self.selected(numbers)
        place = {c.number: i for i, c in enumerate(chosen)}
        body = F.col("_text")
        whole = F.array(*[F.coalesce(c.wrong(body), F.lit(False)) if c.scope == "text" else F.lit(False) for c in chosen])
        clean = F.translate(body, "\r", "")
        pieces = F.when(F.length(clean) > 0, F.split(F.when(F.endswith(clean, F.lit("\n")), F.substr(clean, F.lit(1), F.length(clean) - 1)).otherwise(clean), "\n"))
        rows = computed(texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")), _whole=whole, _lines=pieces).select("_key", "_whole", F.posexplode_outer("_lines").alias("_pos", "_line"))
        first = F.coalesce(F.col("_pos"), F.lit(0)) == 0
        hits = []
        for c in chosen:
            n = F.lit(place[c.number])
            found = F.coalesce(c.wrong(F.col("_line")), F.lit(False)) if c.scope != "text" else F.lit(False)
            if c.scope == "line":
                hits.append(F.when(found, F.struct(n.alias("i"), (F.col("_pos") + 1).alias("line_no"), F.lit(1).alias("n"))))
            elif c.scope == "text":
                hits.append(F.when(first & F.col("_whole")[place[c.number]], F.struct(n.alias("i"), F.lit(None).cast("int").alias("line_no"), F.lit(1).alias("n"))))
            else:  # the first line says that the text is there, whether it counts or not
                hits.append(F.when(first | found, F.struct(n.alias("i"), F.lit(None).cast("int").alias("line_no"), found.cast("int").alias("n"))))
        each = rows.select("_key", F.inline(F.array_compact(F.array(*hits))))
        sums = each.groupBy("_key", "i", "line_no").agg(F.sum("n").alias("n"))
        ok = F.lit(False)
        for c in chosen:
            if c.scope == "count":
                within = (F.col("n") >= c.least) & (F.lit(True) if c.most is None else F.col("n") <= c.most)
                ok = ok | ((F.col("i") == place[c.number]) & within)
        told = lambda f: F.element_at(F.array(*[F.lit(getattr(c, f)) for c in chosen]), F.col("i") + 1).alias(f)
        return sums.where(~ok).select(F.col("_key").alias(key), told("number"), told("name"), told("severity"), F.col("line_no").cast("long").alias("line_no"), "n")

    def summary(self, found: DataFrame, numbers: Sequence[int] | None = None) -> DataFrame:
        """(number, name, severity, n_problems, verdict) of each selected check: PASS without a problem, else its severity."""
        n = found.groupBy("number").agg(F.count("*").alias("n_problems"))
        listed = found.sparkSession.createDataFrame([(c.number, c.name, c.severity) for c in self.selected(numbers)], "number int, name string, severity string")
        out = listed.join(n, "number", "left").withColumn("n_problems", F.coalesce("n_problems", F.lit(0)))
        return out.withColumn("verdict", F.when(F.col("n_problems") == 0, "PASS").otherwise(F.col("severity")))


@dataclass(frozen=True)
class Block:
    """A rendered block: its name, file, markers, and what gives its text (a table of one row, text)."""

    name: str
    path: str
    begin: str
    end: str
    render: Callable[[], DataFrame]


class Blocks:
    """A registry of blocks by name."""

    def __init__(self):
        self._all: dict[str, Block] = {}

    def add(self, block: Block) -> Block:
        """Refuses a name that is taken, and markers that another block of the file has."""
        for b in self._all.values():
            if b.name == block.name or (b.path == block.path and {b.begin, b.end} & {block.begin, block.end}):
                raise ValueError(f"block {block.name} is registered already, or its markers are")
        self._all[block.name] = block
        return block

    def _pairs(self, files: DataFrame) -> DataFrame:
        """(name, path, current, rendered, problem): each block beside its file; files are read once."""
        if not self._all:
            raise ValueError("no block is registered")
        wanted = None
        for b in self._all.values():
            one = b.render().select(F.lit(b.name).alias("name"), F.lit(b.path).alias("path"), F.col("text").alias("rendered"))
            wanted = one if wanted is None else wanted.unionByName(one)
        both = wanted.join(files.select("path", "text"), "path", "left")
        of = lambda f: F.coalesce(*[F.when(F.col("name") == b.name, f(b)) for b in self._all.values()])
        trim = lambda c: F.regexp_replace(c, r"\A\n+|\n+\z", "")
        found = computed(both, problem=F.when(F.col("text").isNull(), "missing-file").otherwise(of(lambda b: regions.region_problem(F.col("text"), b.begin, b.end))), current=of(lambda b: regions.region(F.col("text"), b.begin, b.end)))
        return found.select("name", "path", trim(F.col("current")).alias("current"), trim(F.col("rendered")).alias("rendered"), "problem")

    def states(self, files: DataFrame) -> DataFrame:
        """(name, path, state): FRESH, STALE, or what is wrong with the file or its markers."""
        return self._pairs(files).select("name", "path", F.coalesce("problem", F.when(F.col("current").eqNullSafe(F.col("rendered")), "FRESH").otherwise("STALE")).alias("state"))

    def stale(self, files: DataFrame) -> DataFrame:
        """The hunks by which stale blocks differ from what is rendered: name, path and linediff's columns."""
        pairs = self._pairs(files).where("problem is null and not (current <=> rendered)")
        return linediff.line_hunks(pairs.select("name", "path", "current", "rendered"), "current", "rendered")


def numbers_of(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """One row, text: the table of numbers, each counted from its source."""
    rows = None
    for pos, (label, df) in enumerate(sources):
        one = df.agg(F.count("*").alias("value")).select(F.lit(pos).alias("pos"), F.lit(label).alias("label"), F.format_string("%d", "value").alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    return documents.numbers_table(rows)
