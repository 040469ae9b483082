"""Conversation prefix trie: which conversations begin alike, as nodes with counts.

Every prefix of a conversation has a digest, so a node of the trie is a digest and its
owner is the smallest conversation that has it.  Who owns a prefix owns all longer ones of
his, so each conversation has a first owned depth, found by binary search: in each round
the digests of all conversations at their middle depth are joined with the owners.  The
owned prefixes of a conversation are a chain; chains hang from chains, and what a chain
passes up is summed by doubling (a round joins each chain's sum to the chain twice as far
up), so a trie of any height takes as many rounds as its height has binary digits.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.operators.segments import numbered, running

from .infra import cut, discard, ship
from .mixing import n_words
from .streamed import digests

#: Rounds of search and of doubling at most: longer conversations than 2**48 turns raise.
_ROUNDS = 48


def turns_in_order(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, position, ka, kb, words): turns in order, known by 128 bits of role and text; texts stay where they are."""
    c = lambda name: F.col(f"`{name}`")
    role, text = (F.coalesce(c(x), F.lit("")) for x in (role_col, text_col))
    rows = turns.where(c(conv_col).isNotNull()).select(c(conv_col).cast("long").alias("conv_id"), c(turn_col).alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("ka"), F.xxhash64(F.lit(2), role, text).alias("kb"), n_words(c(text_col)).alias("words"))
    return numbered(rows, ["conv_id"], ["turn", "role", "ka", "kb"]).select("conv_id", "position", "ka", "kb", "words")


def shared_starts(rows: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """rows, each conversation beginning with the first h turns of that whose id is the next multiple of `every` below, h = crc32(id) % most.

    Columns as turns_in_order with depth (from 1) for position, and every conversation once
    more with depth 0 and no turn, so that those without any turn are there too."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = rows.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % every})
    convs = cut(convs, "starts")
    there = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    known = convs.join(there, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("kept"))
    known = cut(known, "starts")
    heads = rows.where((F.col("conv_id") % every == 0) & (F.col("position") < most)).withColumnRenamed("conv_id", "base")
    first = known.where("kept > 0").join(heads, "base").where("position < kept").select("conv_id", (F.col("position") + 1).alias("depth"), "ka", "kb", "words")
    own = rows.join(known, "conv_id").where("position >= h").select("conv_id", (F.col("position") - F.col("h") + F.col("kept") + 1).alias("depth"), "ka", "kb", "words")
    none = F.lit(0).cast("long")
    return first.unionByName(own).unionByName(known.select("conv_id", none.alias("depth"), none.alias("ka"), none.alias("kb"), none.alias("words")))


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, da, db, words): each prefix by 128 bits, the exclusive or of what its turns and their depths hash to; depth 0 has zeros."""
    salted = lambda k, seed: F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), F.col("depth"), F.col("ka"), F.col("kb"))).otherwise(F.lit(0).cast("long"))
    return running(rows, ["conv_id"], "depth", {"da": ("xor", salted("ka", 1)), "db": ("xor", salted("kb", 2))}).select("conv_id", "depth", "da", "db", "words")


_NODE = ["depth", "da", "db"]


def first_owned(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, n, first): number of turns and smallest depth whose node the conversation owns (n + 1: none), by binary search."""
    open_ = cut(paths.groupBy("conv_id").agg(F.max("depth").alias("n")).select("conv_id", "n", F.lit(0).cast("long").alias("low"), (F.col("n") + 1).alias("high")), "search")
    for _ in range(_ROUNDS):
        asked = open_.where("low < high").withColumn("depth", F.floor((F.col("low") + F.col("high")) / 2).cast("long"))
        if asked.isEmpty():
            return open_.select("conv_id", "n", F.col("low").alias("first"))
        # asked and owners are one row a conversation and one a node; the digests of the middles are all that meets the owners
        middle = asked.join(paths.drop("words"), ["conv_id", "depth"])
        seen = middle.join(nodes.select(*_NODE, "owner"), _NODE)
        owns = F.col("owner") == F.col("conv_id")
        moved = seen.select("conv_id", "n", F.when(owns, F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(owns, F.col("depth")).otherwise(F.col("high")).alias("high"))
        before, open_ = open_, cut(open_.where("low >= high").unionByName(moved), "search")
        discard(before)
    raise RuntimeError("a conversation has too many turns to be searched")


def totals(chains: DataFrame) -> DataFrame:
    """(conv_id, leaves, saved): sums over a chain and all that hang from it, for chains (conv_id, up, leaves, saved), by doubling."""
    now = cut(chains, "chains")
    for _ in range(_ROUNDS):
        far = now.where("up is not null")
        if far.isEmpty():
            return now.select("conv_id", "leaves", "saved")
        # what hangs at exactly this distance, and the chain twice as far up
        sums = far.groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        above = now.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        grown = now.join(sums, "conv_id", "left").join(above, "up", "left")
        before, now = now, cut(grown.select("conv_id", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "chains")
        discard(before)
    raise RuntimeError("the trie is too high to be summed")


def trie(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each node of the trie of conversations.

    rows: conv_id, depth (0 without a turn, then 1, 2, ... without gaps), ka, kb, words.

    conv_id is the smallest conversation that begins with the node's turns; n_convs how
    many do; n_leaves the childless nodes at or below it; saved_tokens what is not read
    twice at or below it: for each node its words times one less than its conversations.
    ends_sha256 tells which conversations end there: the SHA-256 of their ids, ascending,
    joined by commas (none: of the empty text)."""
    ship(rows.sparkSession)
    paths = cut(prefixes(rows), "prefixes")
    nodes = cut(paths.groupBy(*_NODE).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("words").alias("words")), "nodes")
    firsts = cut(first_owned(paths, nodes), "firsts")
    # each conversation's node above its first owned one: its owner is the chain that this one hangs from; with none owned, the node where it ends
    edge = firsts.withColumn("depth", F.col("first") - 1).where("depth >= 0")
    above = edge.join(paths.drop("words"), ["conv_id", "depth"]).join(nodes.select(*_NODE, "owner"), _NODE).select("conv_id", F.col("depth").alias("at"), F.col("owner").alias("up"))
    chains = cut(firsts.join(above, "conv_id", "left"), "hung")
    hung = chains.where("first <= n and up is not null")
    owned = nodes.select(F.col("owner").alias("conv_id"), "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    branch = hung.groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(F.count("*").alias("hung"))
    ends = chains.select("conv_id", "n", "first").join(branch, (chains["conv_id"] == branch["conv_id"]) & (chains["n"] == branch["depth"]), "left").where("first <= n").select(chains["conv_id"], F.col("hung").isNull().cast("long").alias("leaves"))
    own = owned.groupBy("conv_id").agg(F.sum("saved").alias("saved")).join(ends, "conv_id").join(hung.select("conv_id", "up"), "conv_id", "left")
    total = totals(own.select("conv_id", "up", "leaves", "saved"))
    below = hung.join(total, "conv_id").groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(F.count("*").alias("hung"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    shape = chains.select(F.col("conv_id").alias("chain"), "n", "first", "up")
    each = owned.join(below, ["conv_id", "depth"], "left").join(shape, F.col("conv_id") == F.col("chain"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    each = each.withColumns({"n_children": zero("hung") + (F.col("depth") < F.col("n")).cast("long"), "leaf": zero("l") + (F.col("hung").isNull() & (F.col("depth") == F.col("n"))).cast("long"), "save": F.col("saved") + zero("s")})
    summed = running(each, ["conv_id"], "depth", {"n_leaves": ("sum", F.col("leaf")), "saved_tokens": ("sum", F.col("save"))}, backwards=True)
    told = digests(chains.select(F.when(F.col("first") <= F.col("n"), F.col("conv_id")).otherwise(F.col("up")).alias("of"), F.col("n").alias("at"), F.col("conv_id").alias("id")), ["of", "at"], "id")
    parent = F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("up"))
    done = summed.join(told, (summed["conv_id"] == told["of"]) & (summed["depth"] == told["at"]), "left")
    return done.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))



#: Common tables for SQL: crc(conv_id, crc) of the decimal ids of conversations.
CRC_TABLES = """b AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS b)"""
CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: unicode(ch)::BIGINT)), lambda x, y: xor(x >> 8, b[(xor(x, y) & 255) + 1])))"

TRIE_SQL = rf"""
WITH {CRC_TABLES},
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
  md5(coalesce(role, '') || chr(31) || coalesce(text, '')) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1),
h AS (SELECT c.conv_id, c.conv_id - c.conv_id % 20 AS base, {CRC.format(text="CAST(c.conv_id AS VARCHAR)")} % 4 AS h FROM c, b),
g AS (SELECT h.*, least(h, coalesce(c.n, 0)) AS kept FROM h LEFT JOIN c ON c.conv_id = h.base),
r AS (SELECT g.conv_id, i + 1 AS depth, k, words FROM g JOIN t ON t.conv_id = g.base WHERE i < kept
  UNION ALL SELECT g.conv_id, i - h + kept + 1, k, words FROM g JOIN t ON t.conv_id = g.conv_id WHERE i >= h
  UNION ALL SELECT conv_id, 0, '', 0 FROM g),
p AS (SELECT conv_id, depth, words, string_agg(k, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS p FROM r),
n AS (SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM p GROUP BY 1, 2),
k AS (SELECT left(p, 32 * (depth - 1)) AS p, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
u AS (SELECT left(n.p, 32 * d) AS p, CAST(count(*) FILTER (WHERE k.p IS NULL) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM (SELECT p, (n_convs - 1) * words AS saved, unnest(range(0, depth + 1)) AS d FROM n) n LEFT JOIN k ON k.p = n.p GROUP BY 1),
e AS (SELECT p, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM p JOIN (SELECT conv_id, max(depth) AS depth FROM r GROUP BY 1) m USING (conv_id, depth) GROUP BY 1)
SELECT n.conv_id, n.depth, o.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, u.n_leaves, u.saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM n LEFT JOIN n o ON n.depth > 0 AND o.p = left(n.p, 32 * (n.depth - 1)) LEFT JOIN k ON k.p = n.p JOIN u ON u.p = n.p LEFT JOIN e ON e.p = n.p"""
