"""Registered queries over whole tables: long name lists, histories, plans that are applied, line differences, checks that share a scan, carried headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.functions.text import computed
from driftwell.operators import apply, checks, history, linediff, migrate, names, regions, segments, textscan
from driftwell.plans.registry import query
from driftwell.plans.registry import table as _t

#: The lines of documents as the scans read them.
_LINES = r"""
b AS (SELECT doc_id, replace(text, chr(13), '') AS t FROM documents WHERE length(text) > 0),
l AS (SELECT doc_id, unnest(string_split(CASE WHEN ends_with(t, chr(10)) THEN left(t, length(t) - 1) ELSE t END, chr(10))) AS line FROM b)"""
#: The names: second words of documents and urls of pages without their scheme and last slash; both begin and end with a letter or digit.
_NAMES = r"""
n AS (SELECT DISTINCT name FROM (SELECT regexp_extract(text, '^\S+\s+([A-Za-z]{3,})', 1) AS name FROM documents UNION ALL SELECT regexp_replace(url, '^https?://|/+$', '', 'g') FROM pages) WHERE name <> '')"""


def _names(spark, d):
    second = _t(spark, d, "documents").select(F.regexp_extract("text", r"^\S+\s+([A-Za-z]{3,})", 1).alias("name"))
    return second.unionByName(_t(spark, d, "pages").select(F.regexp_replace("url", r"^https?://|/+\z", "").alias("name")))


@query(f"WITH {_LINES}, {_NAMES} SELECT name, count(*) AS n_lines FROM l JOIN n ON contains(l.line, n.name) GROUP BY 1")
def name_list_scan(spark, d):
    """How many lines of documents hold each of a long list of names."""
    found = names.counted(textscan.lines(_t(spark, d, "documents").select("text")), _names(spark, d))
    return found.withColumnRenamed("n_rows", "n_lines")


_MARKED = "regexp_replace({}, '([A-Za-z0-9_]+)', chr(1) || '\\1' || chr(1), 'g')"


@query(f"""WITH {_LINES}, {_NAMES}, m AS MATERIALIZED (SELECT {_MARKED.format("line")} AS line FROM l), w AS MATERIALIZED (SELECT name, {_MARKED.format("name")} AS marked FROM n)
SELECT name, count(*) AS n_lines FROM m JOIN w ON contains(m.line, w.marked) GROUP BY 1""")
def name_list_words(spark, d):
    """The same for names as whole words."""
    found = names.counted(textscan.lines(_t(spark, d, "documents").select("text")), _names(spark, d), whole_word=True)
    return found.withColumnRenamed("n_rows", "n_lines")


@query(f"WITH {_NAMES} SELECT name FROM n WHERE EXISTS (SELECT 1 FROM pages WHERE contains(html, n.name))")
def name_list_used(spark, d):
    """Names of the list that some page holds."""
    return names.used(_names(spark, d).where("name <> ''").distinct(), _t(spark, d, "pages"), "html")


#: A history of four lines of orders, with merges from line items into each of them, and checkouts by nation.
_HISTORY = """
c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey >= 4 THEN o_orderkey - 4 END AS parent FROM orders
  UNION SELECT l_orderkey, l_orderkey - 1 - l_partkey % 29 FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 8 = 0 AND l_orderkey > 29),
top AS (SELECT max(o_orderkey) AS top FROM orders),
k AS (SELECT n_name AS name, CASE WHEN n_nationkey % 10 < 9 THEN top - n_nationkey * 17 END AS head, top - n_nationkey % 4 AS other FROM nation, top)"""


@query(f"""
WITH RECURSIVE {_HISTORY},
past(name, side, id) AS (SELECT name, 'head', head FROM k WHERE head IS NOT NULL UNION SELECT name, 'other', other FROM k
  UNION SELECT p.name, p.side, c.parent FROM past p JOIN c ON c.id = p.id WHERE c.parent IS NOT NULL),
a AS (SELECT k.name, count(*) FILTER (WHERE p.id = k.head) > 0 AS ancestor FROM k JOIN past p ON p.name = k.name AND p.side = 'other' GROUP BY 1),
n AS (SELECT o.name, count(*) AS n FROM past o WHERE side = 'other' AND NOT EXISTS (SELECT 1 FROM past h WHERE h.side = 'head' AND h.name = o.name AND h.id = o.id) GROUP BY 1)
SELECT name, CASE WHEN head IS NULL THEN 'unknown' WHEN head = other THEN 'in sync' WHEN ancestor THEN 'behind' ELSE 'diverged' END AS state,
  CASE WHEN head <> other AND ancestor THEN n END AS n_behind FROM k LEFT JOIN a USING (name) LEFT JOIN n USING (name)""")
def history_drift(spark, d):
    """How far checkouts are behind, over a history as long as orders."""
    orders, items = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    line = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") >= 4, F.col("o_orderkey") - 4).alias("parent"), F.lit(1).alias("nth"))
    merged = items.where("l_linenumber = 1 and l_partkey % 8 = 0 and l_orderkey > 29").select(F.col("l_orderkey").alias("id"), (F.col("l_orderkey") - 1 - F.col("l_partkey") % 29).alias("parent"), F.lit(2).alias("nth"))
    top = orders.agg(F.max("o_orderkey").alias("top"))
    k = _t(spark, d, "nation").crossJoin(F.broadcast(top))  # one row
    checkouts = k.select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 10 < 9, F.col("top") - F.col("n_nationkey") * 17).alias("head"), (F.col("top") - F.col("n_nationkey") % 4).alias("other"))
    return history.drift(checkouts, line.unionByName(merged))


@query(r"""
WITH b AS (SELECT doc_id, replace(text, chr(13), '') AS t FROM documents WHERE length(text) > 0),
l AS (SELECT doc_id, unnest(p) AS line, unnest(range(1, len(p) + 1)) AS line_no FROM (SELECT doc_id, string_split(CASE WHEN ends_with(t, chr(10)) THEN left(t, length(t) - 1) ELSE t END, chr(10)) AS p FROM b)),
h AS (SELECT *, CASE WHEN regexp_matches(line, '^[A-Z][^ ]* [^ ]*[A-Za-z]') THEN line END AS header FROM l),
s AS (SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section, count(header) OVER (PARTITION BY doc_id ORDER BY line_no) AS nth FROM h)
SELECT doc_id, md5(section) AS section, nth, count(*) AS n_lines, min(line_no) AS first_line FROM s GROUP BY 1, 2, 3""")
def section_lines(spark, d):
    """Lines under each header of documents, headers carried down and counted on the way."""
    header = F.when(F.col("line").rlike("^[A-Z][^ ]* [^ ]*[A-Za-z]"), F.col("line"))
    lines = textscan.lines(_t(spark, d, "documents").select("doc_id", "text")).withColumn("line_no", F.col("line_no").cast("long"))
    carried = segments.running(lines, ["doc_id"], "line_no", {"section": ("last", header), "nth": ("sum", header.isNotNull().cast("long"))})
    return carried.groupBy("doc_id", F.md5(F.col("section").cast("binary")).alias("section"), "nth").agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"))


@query("""
WITH k AS (SELECT user_id, event_type AS event, 'm' || CAST(floor(value) AS BIGINT) % 3 AS matcher, CAST(json_extract(props, '$.k') AS BIGINT) % 4 = 0 AS ours FROM events),
s AS (SELECT user_id, sum(CAST(ours AS INT)) AS n_removed FROM k GROUP BY 1)
SELECT k.user_id, k.event, k.matcher, count(*) AS n_hooks, CAST(any_value(n_removed) AS BIGINT) AS n_removed FROM k JOIN s ON s.user_id = k.user_id WHERE NOT ours AND n_removed > 0 GROUP BY 1, 2, 3""")
def hook_removal(spark, d):
    """What is left in the settings of every user, a group for each matcher, after the plan is applied to their texts."""
    k = F.get_json_object("props", "$.k").cast("long")
    command = F.when(k % 4 == 0, F.concat(F.lit("sh /kit/hooks/old-"), F.col("event_type"), F.lit(".sh"))).otherwise(F.concat(F.lit("run "), k.cast("string")))
    matcher = F.concat(F.lit("m"), (F.floor("value") % 3).cast("string"))
    groups = _t(spark, d, "events").groupBy("user_id", "event_type", matcher.alias("matcher")).agg(F.collect_list(F.struct(command.alias("command"))).alias("hooks"))
    hooks = groups.groupBy("user_id", "event_type").agg(F.collect_list(F.struct("matcher", "hooks")).alias("g"))
    texts = hooks.groupBy("user_id").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("event_type", "g"))).alias("hooks"), F.lit("x").alias("model"))).alias("text"))
    scripts = [f"old-{e}.sh" for e in ("signup", "purchase", "view", "click", "error")]
    edits = apply.hook_edits(texts, migrate.hook_plan(texts, scripts), "user_id")
    left = migrate.hook_entries(edits.select("user_id", "n_removed", "after"), "after")
    return left.groupBy("user_id", "event", "matcher").agg(F.count("*").alias("n_hooks"), F.max("n_removed").alias("n_removed"))


@query("""
WITH p AS (SELECT doc_id, unnest(p) AS line, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
n AS (SELECT doc_id, i, 0 AS k, line FROM p WHERE i % 7 <> 3 UNION ALL SELECT doc_id, i, 1, '+ ' || doc_id || ':' || i FROM p WHERE i % 11 = 5),
c AS (SELECT doc_id, count(*) FILTER (WHERE i % 7 = 3) AS n_removed, count(*) FILTER (WHERE i % 11 = 5) AS n_added FROM p GROUP BY 1)
SELECT c.doc_id, n_removed, n_added, md5(string_agg(line, chr(10) ORDER BY i, k)) AS digest FROM c JOIN n ON n.doc_id = c.doc_id GROUP BY 1, 2, 3""")
def line_differences(spark, d):
    """Documents against an edited copy (every seventh line gone, a new one after every eleventh): least changes, and the copy rebuilt from the hunks."""
    line = F.split(F.coalesce("text", F.lit("")), "\n")
    new = lambda x, i: F.concat(F.when((i + 1) % 7 == 3, F.array().cast("array<string>")).otherwise(F.array(x)), F.when((i + 1) % 11 == 5, F.array(F.concat(F.lit("+ "), F.col("doc_id").cast("string"), F.lit(":"), (i + 1).cast("string")))).otherwise(F.array().cast("array<string>")))
    pairs = _t(spark, d, "documents").select("doc_id", "text", F.array_join(F.flatten(F.transform(line, new)), "\n").alias("copy"))
    found = linediff.line_hunks(pairs, "text", "copy").groupBy("doc_id").agg(F.sum("old_count").alias("n_removed"), F.sum("new_count").alias("n_added"), F.collect_list(F.struct("old_from", "old_count", "added")).alias("h"))
    joined = pairs.select("doc_id", "text").join(found, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("doc_id", zero("n_removed"), zero("n_added"), F.md5(linediff.patched(F.col("text"), F.col("h")).cast("binary")).alias("digest"))


def text_checks() -> checks.Checks:
    """Ten checks of texts."""
    out, like = checks.Checks(), lambda p: lambda c: c.rlike(p)
    for i, (name, severity, scope, wrong, *more) in enumerate([
        ("tab", "WARN", "line", like("\t")),
        ("trailing-blank", "INFO", "line", like(" $")),
        ("long-line", "WARN", "line", lambda c: F.length(c) > 400),
        ("address", "FAIL", "line", like("[a-z]@[a-z]")),
        ("four-digits", "INFO", "line", like("[0-9]{4}")),
        ("no-capital", "WARN", "count", like("^[A-Z]"), 1),
        ("empty-lines", "INFO", "count", lambda c: c == "", 0, 2),
        ("many-lines", "INFO", "count", lambda c: c.isNotNull(), 0, 40),
        ("no-last-newline", "INFO", "text", lambda c: ~F.endswith(c, F.lit("\n"))),
        ("short", "FAIL", "text", lambda c: F.length(c) < 40),
    ], 1):
        out.add(checks.Check(i, name, severity, scope, wrong, *more))
    return out


_CHECKS_SQL = """
b AS (SELECT doc_id, text, replace(text, chr(13), '') AS t FROM documents),
l AS (SELECT doc_id, unnest(p) AS line, unnest(range(1, len(p) + 1)) AS line_no FROM (SELECT doc_id, string_split(CASE WHEN ends_with(t, chr(10)) THEN left(t, length(t) - 1) ELSE t END, chr(10)) AS p FROM b WHERE length(t) > 0)),
n AS (SELECT b.doc_id, count(*) FILTER (WHERE regexp_matches(line, '^[A-Z]')) AS caps, count(*) FILTER (WHERE line = '') AS empties, count(line) AS lines FROM b LEFT JOIN l USING (doc_id) GROUP BY 1),
found AS (SELECT doc_id, 1 AS number, 'tab' AS name, 'WARN' AS severity, line_no, 1 AS n FROM l WHERE contains(line, chr(9))
  UNION ALL SELECT doc_id, 2, 'trailing-blank', 'INFO', line_no, 1 FROM l WHERE ends_with(line, ' ')
  UNION ALL SELECT doc_id, 3, 'long-line', 'WARN', line_no, 1 FROM l WHERE length(line) > 400
  UNION ALL SELECT doc_id, 4, 'address', 'FAIL', line_no, 1 FROM l WHERE regexp_matches(line, '[a-z]@[a-z]')
  UNION ALL SELECT doc_id, 5, 'four-digits', 'INFO', line_no, 1 FROM l WHERE regexp_matches(line, '[0-9]{4}')
  UNION ALL SELECT doc_id, 6, 'no-capital', 'WARN', NULL, caps FROM n WHERE caps < 1
  UNION ALL SELECT doc_id, 7, 'empty-lines', 'INFO', NULL, empties FROM n WHERE empties > 2
  UNION ALL SELECT doc_id, 8, 'many-lines', 'INFO', NULL, lines FROM n WHERE lines > 40
  UNION ALL SELECT doc_id, 9, 'no-last-newline', 'INFO', NULL, 1 FROM b WHERE NOT ends_with(text, chr(10))
  UNION ALL SELECT doc_id, 10, 'short', 'FAIL', NULL, 1 FROM b WHERE length(text) < 40)"""


@query(f"WITH {_CHECKS_SQL} SELECT doc_id, number, name, severity, line_no, n FROM found")
def ten_checks(spark, d):
    """Ten checks over all documents in one scan."""
    return text_checks().run(_t(spark, d, "documents"), "doc_id")


@query(f"""WITH {_CHECKS_SQL}, k AS (SELECT * FROM (VALUES (1, 'tab', 'WARN'), (2, 'trailing-blank', 'INFO'), (3, 'long-line', 'WARN'), (4, 'address', 'FAIL'), (5, 'four-digits', 'INFO'), (6, 'no-capital', 'WARN'), (7, 'empty-lines', 'INFO'), (8, 'many-lines', 'INFO'), (9, 'no-last-newline', 'INFO'), (10, 'short', 'FAIL')) v(number, name, severity))
SELECT k.number, k.name, k.severity, count(f.number) AS n_problems, CASE WHEN count(f.number) = 0 THEN 'PASS' ELSE k.severity END AS verdict FROM k LEFT JOIN found f ON f.number = k.number GROUP BY 1, 2, 3""")
def checks_summary(spark, d):
    """The verdict of each of the ten checks, those without a problem too."""
    return text_checks().summary(text_checks().run(_t(spark, d, "documents"), "doc_id"))


_COUNTED = ("region", "nation", "supplier", "customer", "part", "orders")


@query("""
WITH r AS (SELECT '| | |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || label || ' | ' || n || ' |', chr(10) ORDER BY pos) AS rendered FROM (
  """ + " UNION ALL ".join(f"SELECT {i} AS pos, '{t}' AS label, count(*) AS n FROM {t}" for i, t in enumerate(_COUNTED)) + """))
SELECT url AS path, CASE WHEN page_id % 4 = 0 THEN 'FRESH' WHEN page_id % 4 = 3 THEN 'missing-end' ELSE 'STALE' END AS state, CASE WHEN page_id % 4 IN (1, 2) THEN 1 ELSE 0 END AS n_hunks,
  CASE WHEN page_id % 4 = 1 THEN '| orders | ' || (SELECT count(*) FROM orders) || ' |' WHEN page_id % 4 = 2 THEN rendered END AS added FROM pages, r""")
def numbers_blocks(spark, d):
    """Blocks of counts in every page: fresh, stale in the last line, empty, or without an end; what a stale one needs."""
    rendered = checks.numbers_of([(t, _t(spark, d, t)) for t in _COUNTED])
    kind = F.col("page_id") % 4
    body = F.when(kind == 1, F.regexp_replace("text", r"\| orders \| [0-9]+", "| orders | 1")).when(kind == 2, "").otherwise(F.col("text"))
    pages = _t(spark, d, "pages").select("page_id", "url", "html").crossJoin(F.broadcast(rendered))  # one row
    old = F.concat(F.coalesce("html", F.lit("")), F.lit("\n<!-- numbers -->\n"), body, F.when(kind == 3, "").otherwise("\n<!-- /numbers -->\n"))
    rows = computed(pages, old=old, rendered=F.col("text"))
    current = regions.region(F.col("old"), "<!-- numbers -->", "<!-- /numbers -->")
    found = computed(rows.select("url", "old", "rendered"), problem=regions.region_problem(F.col("old"), "<!-- numbers -->", "<!-- /numbers -->"), current=F.trim(current, F.lit("\n")))
    state = F.coalesce("problem", F.when(F.col("current") == F.col("rendered"), "FRESH").otherwise("STALE"))
    told = computed(found, state=state)
    stale = lambda c: F.when(F.col("state") == "STALE", F.col(c)).alias(c)
    hunks = linediff.with_hunks(told.select(F.col("url").alias("path"), "state", stale("current"), stale("rendered")), "current", "rendered")
    return hunks.select("path", "state", F.size("hunks").cast("long").alias("n_hunks"), F.array_join(F.get("hunks", F.lit(0))["added"], "\n").alias("added"))
