"""From documents to packed sequences: five stages, each one of the operators of driftwell.llm.

Toxic documents go; documents of no known language go; one document of each group of
near copies stays (five-word shingles, Jaccard 0.8); passages that repeat go; what is
left is packed.  Each stage's result is written as Parquet and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm import language_id, toxicity
from driftwell.llm.infra import cut, discard, row_id
from driftwell.llm.ngram_join import ngram_join
from driftwell.llm.packing import pack_documents
from driftwell.llm.queries import table, vocabulary
from driftwell.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents are rejected from this toxicity on.
TOXIC = 0.7
#: Documents are rejected where the likeliest language is less probable than this.
LEAST_PROBABLE = 0.5
#: Words of a passage that counts as repeated.
WINDOW = 35


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; null and empty texts stay.

    Rows are judged one by one: repeated rows are treated alike, other columns go, an empty
    table stays empty."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model, out="toxicity", threshold=TOXIC).where("predicted = 0").select(*COLUMNS)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with at least LEAST_PROBABLE; lang becomes what was found.

    Sources stand for hosts.  A text without a letter has no language and goes (null and
    empty ones among them).  Rows are judged one by one: repeated rows are treated alike,
    other columns go, an empty table stays empty."""
    model = language_id.TextModel(language_id.pair_counts(docs, "text", "lang"))
    found = language_id.fuse(docs, model, None, "text", markup=False, host_col="source", keep=["doc_id", "text", "source", "n_chars"])
    return found.where("lang <> 'und'").where(F.col("probability") >= LEAST_PROBABLE).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest id (a null one only where there is no other); repeated rows are copies.

    Rows, not ids, are what is grouped: texts that link with nothing stay, whatever ids they
    share or lack, and so do wordless ones."""
    keyed = docs.select(*COLUMNS).withColumn("rid", F.concat_ws("-", F.hex(row_id("doc_id", "text")), F.hex(row_id(F.lit(2), F.col("doc_id"), F.col("text")))))
    found = cut(ngram_join(keyed, id_col="rid", k=5, num=80, den=100).where("n_shingles > 0").distinct(), "groups")
    ids = keyed.select("doc_id", "rid").join(found, "rid")
    kept = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("k")).select("k.rid")
    linked = keyed.join(kept, "rid", "left_semi").groupBy("rid").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return linked.unionByName(keyed.join(found, "rid", "left_anti").select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages of WINDOW words and more that occur elsewhere too; untouched texts stay as they are."""
    out = substring_dedup(docs.select(*COLUMNS), window=WINDOW)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 1024.

    A null or empty text is its end token; repeated rows are packed as often as they come;
    other columns go; an empty table gives an empty result."""
    return pack_documents(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), capacity=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_language),
    ("ngram_jaccard", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: SQL can express neither a classifier nor a tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table goes when the next one is written, the last stays for the caller and goes at the end."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        done = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            discard(last)
        docs = last = done
    return docs
