"""The registered queries opN_<name>: each applies its operator to whole tables and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, conversation_repair, language_id, mixing, quality, toxicity
from .embedding_dedup import near_dedup
from .labelled import HELD_OUT, fold
from .ngram_join import ngram_join
from .packing import pack_documents
from .prefix_trie import CRC, CRC_TABLES, TRIE_SQL, shared_starts, trie, turns_in_order
from .streamed import digests
from .substring_dedup import substring_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("word_bpe_49k.json")
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded="decoded")
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, threshold=0.7).select("doc_id", (fold("doc_id") == HELD_OUT).alias("held_out"), "score", "predicted")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, threshold=0.5).select("doc_id", (fold("doc_id") == HELD_OUT).alias("held_out"), "score", "predicted")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), capacity=1024)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.TextModel(language_id.pair_counts(table(spark, sf_dir, "documents"), "text", "lang"))
    return language_id.fuse(table(spark, sf_dir, "pages"), model, "page_id", "html", "url")


def op10_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults put in by crc32("conv_id:turn") % 20 (nulls: one space): 0 dropped, 1 emptied, 2 without .!?, 3 twice, 4 by the user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20).alias("d")).where("d <> 0")
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("time")).drop("time")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    rows = conversation_repair.diagnosed(damaged(turns))
    found = conversation_repair.scripts(rows)
    kept = conversation_repair.repaired(rows, found).where("edit <> 'D'")
    hashes = digests(kept.select("conv_id", "place", F.concat("role", F.lit(":"), "text").alias("line")), ["conv_id"], "place", "line", "\n")
    out = turns.select("conv_id").distinct()
    for part in (conversation_repair.summary(rows, found), hashes):
        part = part.withColumnRenamed("conv_id", "c")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turns_in_order(table(spark, sf_dir, "conversations"))
    return trie(shared_starts(turns, every=20, most=4))


_ALL = (op1_bpe_encode_decode, op2_nearest_neighbours, op3_toxicity, op4_quality, op5_best_fit_packing, op6_ngram_jaccard_join, op7_substring_dedup, op8_embedding_near_dedup, op9_language_id, op10_chat_rotation, op11_conversation_repair, op12_source_mixing, op13_prefix_trie)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_WORDS = r"'[^\x20\x09-\x0D]+'"
#: Components by the closure of links: e(a, b) has both directions, every vertex is in s.
_CLOSURE = """r AS (SELECT v, v AS u FROM s UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a),
c AS (SELECT v, min(u) AS component_id FROM r GROUP BY 1)"""

OP6_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id AS v, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}), []) AS w FROM documents),
s AS (SELECT v, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
x AS (SELECT v, len(s) AS n, unnest(s) AS h FROM s),
p AS (SELECT a.v AS a, b.v AS b, any_value(a.n) + any_value(b.n) - count(*) AS n_either, count(*) AS n_both FROM x a JOIN x b ON a.h = b.h AND a.v < b.v GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * n_both >= 85 * n_either), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), {_CLOSURE}
SELECT s.v AS doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN c ON c.v = s.v"""

OP7_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, {_WORDS}), []) AS w FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w)),
t AS (SELECT h FROM k GROUP BY 1 HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, unnest(range(i, i + 35)) AS pos FROM k WHERE h IN (SELECT h FROM t))),
a AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM a WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = a.doc_id AND g.pos = a.pos) GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

OP8_SQL = f"""
WITH RECURSIVE s AS (SELECT vec_id AS v FROM embeddings),
x AS MATERIALIZED (SELECT vec_id AS v, label, list_transform(embedding, lambda y: CAST(y AS DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
l AS (SELECT a.v AS a, b.v AS b FROM x a JOIN x b ON a.label = b.label AND a.v < b.v AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), n AS (SELECT a AS v, count(*) AS n FROM e GROUP BY 1), {_CLOSURE}
SELECT s.v AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c.component_id, c.component_id = s.v AS kept FROM s JOIN c ON c.v = s.v LEFT JOIN n ON n.v = s.v"""



def _repair_sql() -> str:
    """The least (cost, labels) behind each turn from each state of the grammar, from the last turn to the first, as text: nine digits of cost, then labels."""
    add = lambda label, cost, v: f"lpad(CAST(CAST(left({v}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '{label}' || substr({v}, 10)"  # noqa: E731
    fits, to = {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}, {0: 2, 1: 2, 2: 3, 3: 2}
    reads = ", ".join("least(" + ", ".join([add("D", 4, f"n{g}"), *(f"CASE WHEN NOT must AND ini = '{r}' THEN {add('K', '3 * cut', f'n{t}')} END" for r, t in fits[g]), f"CASE WHEN NOT must THEN {add('R', '3 + 3 * cut', f'n{to[g]}')} END"]) + f") AS c{g}" for g in range(4))
    once = ", ".join(f"least(c{g}, {add('I', 3, f'c{to[g]}')}) AS i{g}" for g in range(4))
    twice = ", ".join(f"least(c{g}, {add('I', 3, f'i{to[g]}')}) AS n{g}" for g in range(4))
    return rf"""
WITH RECURSIVE {CRC_TABLES},
x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC.format(text="coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS d FROM conversations, b),
y AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM x, range(2) r(k) WHERE d <> 0 AND (d = 3 OR k = 0)),
z AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM y),
w AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '.' END AS ini FROM z),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-]*\z') THEN 'truncated' END AS fault FROM w),
t AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS must, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut,
  CASE WHEN lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS bad FROM f),
v AS (SELECT DISTINCT conv_id, n + 1 AS i, '000000000' AS n0, '000000006II' AS n1, '000000003I' AS n2, '000000000' AS n3 FROM t
  UNION ALL SELECT conv_id, i, {twice} FROM (SELECT *, {once} FROM (SELECT t.conv_id, t.i, {reads} FROM v JOIN t ON t.conv_id IS NOT DISTINCT FROM v.conv_id AND t.i = v.i - 1))),
p AS (SELECT conv_id, CAST(left(n0, 9) AS BIGINT) AS cost, substr(n0, 10) AS audit FROM v WHERE i = 1),
l AS (SELECT conv_id, label, k, count(*) FILTER (WHERE label <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i, count(*) FILTER (WHERE label <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS j
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS label, unnest(range(1, length(audit) + 1)) AS k FROM p)),
s AS (SELECT l.conv_id, l.label, k, j, role, text, max(CASE WHEN l.label = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS s FROM l LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.i = l.i AND l.label <> 'I'),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN label = 'K' THEN role WHEN (j - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN label = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS repaired_sha256 FROM s WHERE label <> 'D' GROUP BY 1),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, CAST(sum(bad) AS BIGINT) AS illegal FROM t GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM o.conv_id"""


REPAIR_SQL = _repair_sql()

ORACLE_SQL: dict[str, str] = {"op6_ngram_jaccard_join": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op8_embedding_near_dedup": OP8_SQL, "op10_chat_rotation": chat.ROTATE_SQL, "op11_conversation_repair": REPAIR_SQL, "op12_source_mixing": mixing.MIX_SQL, "op13_prefix_trie": TRIE_SQL}
