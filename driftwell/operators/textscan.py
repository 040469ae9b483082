"""Line-numbered literal and regular-expression scans with exclusion chains."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules for secrets: name, pattern (Java syntax). Fixed values.
SECRET = r"""(?i)(password|secret|key|token)[^\n]*[=:]\s*["'][^"'$][^"']{7,}["']"""
SECRET_EXCLUSIONS = ("your-api-key", "test123", "(?i)example", r"\$\{[^\n]*\}", r"\{\{[^\n]*\}\}", "NEVER DO THIS")
SECRET_RULES = (
    ("access-key-id", r"AKIA[0-9A-Z]{16}"),
    ("hosted-git-token", r"ghp_[0-9a-zA-Z]{36}"),
    ("private-key", r"-----BEGIN[^\n]*PRIVATE KEY-----"),
    ("connection-string", r"(?i)(mongodb://|mysql://|postgres://|redis://)[^@]*:[^@]*@"),
)
#: Stated counts: pattern, which number of the match, what it counts. Fixed values.
COUNT_RULES = (
    (r"[0-9]+ [Ss]pecialized [Aa]gents", "first", "agents"),
    (r"[0-9]+ [Hh]ook [Ss]cripts?", "first", "hooks"),
    (r"[0-9]+ [Hh]ooks\b", "first", "hooks"),
    (r"Total Hooks:\*{0,2} ?[0-9]+", "last", "hooks"),
    (r"[0-9]+ [Qq]uality [Gg]ates", "first", "hooks"),
    (r"Should show [0-9]+", "last", "agents"),
    (r"[0-9]+ ([Oo]perational )?[Ss]kills\b", "first", "skills"),
    (r"[0-9]+ [Cc]ommands\b", "first", "commands"),
    (r"[0-9]+-agent", "first", "agents"),
)


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """df's other columns, line_no (from 1) and line; the empty piece after a last newline is no line, CR is dropped."""
    rest = [c for c in df.columns if c != text]
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), "\r", "")
    parts = F.split(F.when(F.endswith(clean, F.lit("\n")), F.substring(clean, F.lit(1), F.length(clean) - 1)).otherwise(clean), "\n")
    return df.where(F.length(text) > 0).select(*rest, F.posexplode(parts).alias("pos", "line")).select(*rest, (F.col("pos") + 1).alias("line_no"), "line")


def literal(df: DataFrame, needle: str, line: str = "line") -> DataFrame:
    return df.where(F.contains(F.col(line), F.lit(needle)))


def matching(df: DataFrame, pattern: str, excluded: Sequence[str] = (), line: str = "line", path: str | None = None) -> DataFrame:
    """Lines that match, less those of which path:line matches an exclusion."""
    shown = F.concat(F.col(path).cast("string"), F.lit(":"), F.col(line)) if path else F.col(line)
    out = df.where(F.col(line).rlike(pattern))
    for x in excluded:
        out = out.where(~shown.rlike(x))
    return out


def any_of(line: Column, names: Sequence[str]) -> Column:
    """Which of the literals the line holds, in their order (an array)."""
    return F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(line, n))


def scan_names(df: DataFrame, names: Sequence[str], line: str = "line") -> DataFrame:
    """One row for each name that a line holds: the theta join of a fixed list with lines, without a join."""
    return df.withColumn("name", F.explode(any_of(F.col(line), names)))


def whole_word(name: str) -> str:
    return rf"(^|[^A-Za-z0-9_]){re.escape(name)}([^A-Za-z0-9_]|\z)"


def active_reference(name: str) -> str:
    """A name as a file or as the value of a routing directive, not in prose and not within a longer name."""
    n = re.escape(name)
    return rf"""agents/{n}\.md|subagent_type["']?\s*[:=]\s*["']?{n}(?:["', )]|\z)|"agent"\s*:\s*"{n}"|(?:^|[\s(=])agent\s*:\s*{n}(?:[\s,)]|\z)"""


def required(df: DataFrame, needles: Sequence[tuple[str, str, str]], path: str = "path", text: str = "text") -> DataFrame:
    """needles: (path, literal, label). Rows for those whose file is missing or lacks the literal."""
    want = df.sparkSession.createDataFrame(list(needles), f"{path} string, needle string, label string")
    joined = want.join(df.select(path, text), path, "left")
    return joined.groupBy(path, "needle", "label").agg(F.max(F.coalesce(F.contains(F.col(text), F.col("needle")), F.lit(False))).alias("found")).where(~F.col("found")).drop("found")


def secrets(df: DataFrame, line: str = "line", path: str | None = None) -> DataFrame:
    """Lines that may hold a secret, with the rule that says so; one pass over the lines."""
    shown = F.concat(F.col(path).cast("string"), F.lit(":"), F.col(line)) if path else F.col(line)
    generic = F.col(line).rlike(SECRET)
    for x in SECRET_EXCLUSIONS:
        generic = generic & ~shown.rlike(x)
    hits = F.array_compact(F.array(F.when(generic, F.lit("generic")), *[F.when(F.col(line).rlike(p), F.lit(n)) for n, p in SECRET_RULES]))
    return df.withColumn("rule", F.explode(hits))


def stated_numbers(df: DataFrame, expected: dict[str, int], rules: Sequence[tuple[str, str, str]] = COUNT_RULES, line: str = "line") -> DataFrame:
    """Phrases that state a count other than the expected one; lines with the word grep are left out."""
    def phrases(pattern: str, which: str, what: str) -> Column:
        number = lambda m: F.try_element_at(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), F.lit(1 if which == "first" else -1))
        hits = F.regexp_extract_all(F.col(line), F.lit(pattern), F.lit(0))
        return F.transform(hits, lambda m: F.struct(m.alias("phrase"), number(m).try_cast("long").alias("stated"), F.lit(what).alias("what"), F.lit(expected.get(what)).cast("long").alias("derived")))

    found = F.concat(*[phrases(*r) for r in rules])
    rows = df.where(~F.col(line).rlike(r"\bgrep\b")).withColumn("f", F.explode(found))
    return rows.select(*df.columns, "f.*").where("stated <> derived")


def first_line_is(text: Column, header: str) -> Column:
    return F.split_part(F.translate(text, "\r", ""), F.lit("\n"), F.lit(1)) == header


def has_line_prefix(text: Column, prefix: str) -> Column:
    return text.rlike(rf"(?m)^{re.escape(prefix)}")


def kebab(name: Column) -> Column:
    return name.rlike(r"\A[a-z0-9]+(-[a-z0-9]+)*\z")


def under(path: Column, roots: Sequence[str]) -> Column:
    """Whether a path is one of the roots or below it, without case, either slash."""
    p = F.lower(F.regexp_replace(path, r"\\", "/"))
    out = F.lit(False)
    for r in roots:
        r = r.replace("\\", "/").rstrip("/").lower()
        out = out | (p == r) | F.startswith(p, F.lit(r + "/"))
    return out


def shape_matches(args: Column, shape: Sequence[str | None]) -> Column:
    """Whether an array has exactly this shape; None stands for any value."""
    ok = F.size(args) == len(shape)
    for i, s in enumerate(shape):
        if s is not None:
            ok = ok & (F.get(args, F.lit(i)) == s)
    return F.coalesce(ok, F.lit(False))
