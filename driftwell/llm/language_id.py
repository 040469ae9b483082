"""Language ID by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior for each page: the likelihood of its text
under byte-pair models of each language; the language its markup declares; the suffix of
its address; and a prior of its host.  How far declarations and suffixes can be trusted
is learnt by grouped counts against what the text says; host priors are counts of the
same, smoothed towards the domain's, and those towards the whole corpus's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .infra import cut, ship, slices, working
from .wordhash import chunks

#: Languages whose table a task holds at a time (0.5 MB each), strength of priors, weight of a byte pair.
LANGUAGES, HOST_STRENGTH, DOMAIN_STRENGTH, TEXT_WEIGHT = 256, 20.0, 50.0, 0.25
_DROP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", re.DOTALL | re.IGNORECASE)
_FOLD = np.arange(256, dtype=np.int64)
_FOLD[65:91] += 32
_FOLD[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32  # signs and digits say nothing of a language


def visible(html: str) -> str:
    return _DROP.sub(" ", html)


def pair_counts(docs: DataFrame, text_col: str, lang_col: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By language, in the order of names: the byte pairs of all its labelled documents and their counts; summed in tasks, then by language and pair.

    What comes to the driver is at most 65,536 pairs a language, of which texts use some thousands."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("language", int)
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for at, part in chunks(x or b"" for x in b.column(0).cast(pa.binary()).to_pylist()):
                by: dict[str, list[bytes]] = {}
                for k, t in zip(langs[at : at + len(part)], part, strict=True):
                    if k:
                        by.setdefault(k, []).append(t)
                for k, texts in by.items():
                    c = _FOLD[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
                    n = np.bincount(c[:-1] * 256 + c[1:], minlength=65536)
                    total[k] = total[k] + n if k in total else n
                    if len(total) > LANGUAGES:
                        yield told(total)
                        total = {}
        yield told(total)

    def told(total: dict[str, np.ndarray]) -> pa.RecordBatch:
        hits = [np.flatnonzero(n) for n in total.values()]
        names = pa.array([k for k, hit in zip(total, hits, strict=True) for _ in range(len(hit))], pa.string())
        pairs = np.concatenate([np.zeros(0, np.int64), *hits])
        counts = np.concatenate([np.zeros(0, np.int64), *(n[hit] for n, hit in zip(total.values(), hits, strict=True))])
        return pa.RecordBatch.from_arrays([names, pa.array(pairs, pa.int32()), pa.array(counts, pa.int64())], names=["lang", "pair", "n"])

    summed = docs.select(F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")).mapInArrow(count, "lang string, pair int, n long").groupBy("lang", "pair").agg(F.sum("n").alias("n"))

    by = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pair", "n"))).alias("p")).select("lang", "p.pair", "p.n").orderBy("lang")
    return {r["lang"]: (np.array(r["pair"], np.int32), np.array(r["n"], np.int64)) for r in by.toLocalIterator()}


class TextModel:
    """log P(next byte | byte) for each language, as tables of LANGUAGES languages, of which one is held."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs, self.pairs, self.held = list(counts), list(counts.values()), (-1, np.zeros(0))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": (-1, np.zeros(0))}

    def table(self, start: int) -> np.ndarray:
        """The table of the languages from start on."""
        if self.held[0] != start:
            some = self.pairs[start : start + LANGUAGES]
            table = np.zeros((65536, len(some)))
            for i, (pair, n) in enumerate(some):
                c = np.zeros(65536)
                c[pair] = n
                c = c.reshape(256, 256)
                back = (c.sum(0) + 0.1) / (c.sum() + 25.6)
                table[:, i] = np.log((c + 4 * back) / (c.sum(1, keepdims=True) + 4)).ravel()
            table[32 * 256 + 32] = 0
            self.held = start, table
        return self.held[1]

    def score(self, texts: list[bytes]) -> np.ndarray:
        """For each text, by language: the sum of log-likelihoods of its pairs; last, the number of pairs with a letter."""
        out = np.zeros((len(texts), len(self.langs) + 1))
        for start in range(0, max(1, len(self.langs)), LANGUAGES):
            table = self.table(start)
            for at, part in chunks(texts):
                c = _FOLD[np.frombuffer(b" " + b"  ".join(part) + b" ", np.uint8)]
                code = c[:-1] * 256 + c[1:]
                ends = np.cumsum([len(t) + 2 for t in part]) - 1
                starts = np.r_[0, ends[:-1] + 1]
                for i, values in [*enumerate(table.T, start), (-1, None)]:
                    run = np.r_[0, np.cumsum(code != 32 * 257 if values is None else values[code])]
                    out[at : at + len(part), i] = run[ends] - run[starts]
        return out


def _with_text_evidence(df: DataFrame, model: TextModel, markup: bool, with_text: bool = False) -> DataFrame:
    """df, without its text unless with_text, and ll: by language, the tempered log-likelihood of `text` (null if it has no letter)."""
    held = df.sparkSession.sparkContext.broadcast(model)  # the counts: at most 65,536 pairs a language
    names = df.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("language", int)  # nothing of its own stays
        m = held.value
        for b in slices(batches):
            raw = b.column(place).to_pylist()
            texts = [(visible(t) if markup else t).encode() if t else b"" for t in raw]
            got = m.score(texts)
            ll = [None if not x[-1] else (TEXT_WEIGHT * x[:-1]).tolist() for x in got]
            kept = [i for i in range(len(names)) if with_text or i != place]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(ll, pa.list_(pa.float64()))], names=[*(names[i] for i in kept), "ll"])

    return df.mapInArrow(run, (df.select("*") if with_text else df.drop("text")).schema.add("ll", T.ArrayType(T.DoubleType())))


def _best(scores: Column) -> Column:
    """0-based place of the largest value, the first of equals; null for a null array."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def _trust(rows: DataFrame, seen: str, n: int) -> DataFrame:
    """(seen, trust): by language, log P(seen | language), from counts against what the texts say, add-one smoothed."""
    counts = rows.where(f"{seen} is not null and best is not null").groupBy(seen, "best").agg(F.count("*").alias("c"))
    by = counts.groupBy(seen).agg(F.map_from_entries(F.collect_list(F.struct("best", "c"))).alias("m"))
    totals = counts.groupBy("best").agg(F.sum("c").alias("c")).agg(F.map_from_entries(F.collect_list(F.struct("best", "c"))).alias("t"))
    return by.crossJoin(F.broadcast(totals)).select(seen, F.expr(f"transform(sequence(0, {n - 1}), i -> ln((coalesce(m[i], 0) + 1.0D) / (coalesce(t[i], 0) + 20.0D)))").alias(f"{seen}_trust"))


def fuse(df: DataFrame, model: TextModel, id_col: str | None, text_col: str, url_col: str | None = None, markup: bool = True, host_col: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(id, lang, probability, text_lang, declared) for each row: the most probable language by all evidence.

    keep: columns of df that come along, the text among them if it is named (they must not be
    called like the result's); without an id_col there is no id.

    Defined results: a text without letters (null, empty, signs only) has no text evidence
    and is decided by the rest; with none at all lang is "und", probability 0; unknown
    declarations and suffixes count as absent until seen with some language; a missing url
    or host has the corpus's prior; equal posteriors go to the language first by name; a
    repeated row gets the same answer again; other columns are not read, so their names
    cannot clash; an empty table gives an empty result.
    """
    spark = df.sparkSession
    ship(spark)
    n = len(model.langs)
    text = F.col(f"`{text_col}`")
    url = F.lower(F.col(f"`{url_col}`")) if url_col else F.lit(None).cast("string")
    blank = lambda c: F.nullif(c, F.lit(""))
    host = F.col(f"`{host_col}`") if host_col else blank(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1))
    # a language's code as a part of the path, else the top domain
    suffix = F.coalesce(blank(F.regexp_extract(url, r"^[a-z]+://[^/]+/([a-z]{2})(?:/|$)", 1)), blank(F.regexp_extract(url, r"^[a-z]+://[^/:?#]*\.([a-z]{2,})(?:[/:?#]|$)", 1)))
    declared = blank(F.lower(F.regexp_extract(text, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))) if markup else F.lit(None).cast("string")
    carried = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep) if c != text_col]
    again = [F.col("text" if c == text_col else f"k{i}").alias(c) for i, c in enumerate(keep)]
    named = lambda: [F.col("id").alias(id_col)] if id_col else []
    ident = F.col(f"`{id_col}`") if id_col else F.lit(None).cast("long")
    rows = df.select(ident.alias("id"), text.alias("text"), host.alias("host"), suffix.alias("suffix"), declared.alias("declared"), *carried)
    if not n:
        return rows.select(*named(), *again, F.lit("und").alias("lang"), F.lit(0.0).alias("probability"), F.lit(None).cast("string").alias("text_lang"), "declared")
    rows = rows.withColumn("domain", F.when(F.col("host").contains("."), F.substring_index("host", ".", -2)).otherwise(F.col("host")))
    seen = cut(_with_text_evidence(rows, model, markup, text_col in keep).withColumn("best", _best(F.col("ll"))), "evidence")

    # grouped counts: of hosts, their domains, and all (n numbers)
    votes = cut(seen.groupBy("host", "domain", "best").agg(F.count("*").alias("c")), "votes")
    by_best = lambda *key: votes.where("host is not null").groupBy(*key, "best").agg(F.sum("c").alias("c")).groupBy(*key).agg(F.map_from_entries(F.filter(F.collect_list(F.struct("best", "c")), lambda x: x["best"].isNotNull())).alias("m"))
    dense = lambda name: F.expr(f"transform(sequence(0, {n - 1}), i -> coalesce(m[i], 0L))").alias(name)
    # written first: a join right above its aggregation could not split a domain of many hosts
    hosts, domains = cut(by_best("host", "domain").select("host", "domain", dense("h")), "hosts"), cut(by_best("domain").select("domain", dense("d")), "domains")
    total = np.ones(n)
    for r in votes.where("best is not null").groupBy("best").agg(F.sum("c").alias("c")).collect():  # one row a language
        total[r["best"]] += r["c"]
    base = F.array(*[F.lit(float(x)) for x in total / total.sum()])
    smooth = lambda own, prior, k: F.zip_with(own, prior, lambda c, p: (c + k * p) / (F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x) + k))
    prior = hosts.join(domains, "domain").select("host", smooth(F.col("h"), smooth(F.col("d"), base, DOMAIN_STRENGTH), HOST_STRENGTH).alias("prior"))

    out = seen.join(prior, "host", "left").withColumn("prior", F.coalesce("prior", base))
    for s in ("declared", "suffix"):
        out = out.join(_trust(seen, s, n), s, "left")
    flat = F.array(*[F.lit(0.0)] * n)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    post = add(F.transform("prior", lambda p: F.log(p)), F.coalesce("ll", flat))
    post = add(add(post, F.coalesce("declared_trust", flat)), F.coalesce("suffix_trust", flat))
    known = F.coalesce(F.col("ll").isNotNull() | F.col("declared_trust").isNotNull() | F.col("suffix_trust").isNotNull(), F.lit(False))
    names = F.array(*[F.lit(x) for x in model.langs])
    out = out.withColumn("post", post).withColumn("top", F.array_max("post"))
    return out.select(
        *named(),
        *again,
        F.when(known, F.get(names, _best(F.col("post")))).otherwise("und").alias("lang"),
        F.when(known, 1 / F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))).otherwise(0.0).alias("probability"),
        F.get(names, F.col("best")).alias("text_lang"),
        "declared",
    )
