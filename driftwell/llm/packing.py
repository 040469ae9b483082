"""Best-fit packing with bound-certified repacking.

Documents become token pieces of at most `capacity`.  A full piece is a sequence of its
own.  The others are dealt to groups of bounded size by a hash; each group packs by
best-fit decreasing and compares its number of sequences with a lower bound from dual
feasible functions.  A group that meets the bound is optimal, certified, and final.  A
group with a gap gives up its emptiest sequences; their pieces meet those of other such
groups in groups of the next round, of the same bounded size, and are packed again, until
one group takes them all or rounds no longer lessen them.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .infra import cut, row_id, ship, working

#: Pieces that a worker remembers; past it only those asked for again stay (results don't depend on it).
CACHE = 150_000
#: The byte-level pattern. Fixed value.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces in a group, and rounds at most (a round leaves half of the groups or is the last).
GROUP, MOST_ROUNDS = 20_000, 40
#: Where a text may be cut before a space: after a letter, a digit or a visible sign. A match of the byte-level pattern never goes on from there to a space.
_BEFORE_SPACE = re.compile(r"(?<=[^\W_])(?= )|(?<=[!-~])(?= )")
#: White space and what may be taken for it: a space after one of these is no place to cut. Those that are common are looked for together with the space.
_COMMON = tuple(c + " " for c in " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f")
_RARE = tuple(map(chr, (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)))


class _ByteBPE:
    """Ids of texts as the tokenizers library gives them, with a cache of the pieces that begin with a space.

    New pieces go to the library, or to another public one that gives the same ids faster."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.marks = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        spec = json.loads(self.lib.to_str())
        self.quick = _quick(spec)
        # of each token, the bytes it stands for: a printable sign each
        vocab = spec["model"]["vocab"] if self.quick else {}
        self.bytes_of = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        self.bytes_of[list(vocab.values())] = [len(t) for t in vocab]

    def _library(self, texts: list[str]) -> list[bytes]:
        # the fast form leaves out offsets, which nobody reads here; ids are the same
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False))]

    def _pieces(self, texts: list[str]) -> list[bytes]:
        """The ids of many short texts: by the quick form where there is one and the text holds no added token."""
        if self.quick is None or any(m in t for m in self.marks for t in texts):
            return self._library(texts)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in map(self.quick, texts)]

    def _inner(self, texts: list[str]) -> Iterable[bytes]:
        """The ids of many pieces that were cut out within texts, as one text: each begins with a space and ends in
        no white space, so the pattern cuts where they meet, and the bytes of the tokens tell where that is."""
        whole = "".join(texts)
        if self.quick is None or any(m in whole for m in self.marks):
            return self._pieces(texts)
        ids, ends = np.array(self.quick(whole), "<u4"), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        if not whole.isascii():  # from signs to bytes
            ends = np.r_[np.flatnonzero((np.frombuffer(raw := whole.encode(), np.uint8) & 0xC0) != 0x80), len(raw)][ends]
        at = 4 * np.searchsorted(np.cumsum(self.bytes_of[ids]), ends, side="right")
        raw = ids.tobytes()
        return (raw[a:b] for a, b in pairwise([0, *at.tolist()]))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known, self.before = {}, self.known
        chunks = [_cut(t) for t in texts]
        fresh = set().union(*chunks) - self.known.keys()
        again = fresh & self.before.keys()
        self.known.update(zip(again, map(self.before.__getitem__, again), strict=True))
        fresh -= again
        outer = list(fresh & {x for c in chunks for x in (c[0], c[-1])})
        inner = list(fresh.difference(outer))
        for new, ids in ((outer, self._pieces), (inner, self._inner)):
            if new:
                self.known.update(zip(new, ids(new), strict=True))
        look = self.known.__getitem__
        return [b"".join(map(look, c)) for c in chunks]


def _quick(spec: dict) -> Callable[[str], list[int]] | None:
    """A faster encoder of the same vocabulary, for plain byte-level BPE whose tokens are numbered in the order of their merges; else None."""
    import tiktoken

    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
        return None
    # the printable form of a byte: itself, or the next sign from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    added = {t["content"] for t in spec["added_tokens"]}
    if len(merges) + 256 != len([t for t in vocab if t not in added]) or any(vocab.get(x + y) != 256 + i for i, (x, y) in enumerate(merges)) or any(c not in vocab for c in byte_of):
        return None
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in added}
    return tiktoken.Encoding("byte-level", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _cut(text: str) -> list[str]:
    """The text in pieces that the pattern takes one by one: cut before each space that no white space precedes."""
    if any(c in text for c in _COMMON) or (not text.isascii() and any(c in text for c in _RARE)) or "\0" in text:
        return _BEFORE_SPACE.split(text)
    return text.replace(" ", "\0 ").split("\0")


@lru_cache(maxsize=4)
def _load(path: str) -> _ByteBPE:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return _ByteBPE(path)


def token_pieces(docs: DataFrame, path: str, text_col: str = "text", capacity: int = 1024, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """docs' other columns and piece int, start long, length long, ids_crc32 long, and ids binary (little-endian unsigned 32-bit) if with_ids.

    A document is the ids of its text, then end_id.  Null text counts as empty.  Only
    documents longer than capacity are cut; the first of their pieces takes what is over.
    """
    ship(docs.sparkSession)
    new = ["piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    keep = [c for c in docs.columns if c not in (*new, "ids", text_col)]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("packing", _load.cache_clear)
        bpe = _load(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            held: list[str] = []
            for i, t in enumerate(texts):
                held.append(t)
                if i + 1 < len(texts) and sum(map(len, held)) < 1 << 21:
                    continue
                for j, x in enumerate(bpe.encode(held), i + 1 - len(held)):
                    x += end
                    n = len(x) // 4
                    a, k = 0, 0
                    while a < n:
                        b = a + ((n - 1) % capacity + 1 if a == 0 else capacity)
                        part = x[4 * a : 4 * b]
                        row.append(j)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part)
                        a, k = b, k + 1
                held = []
            at = pa.array(row, pa.int64())
            cols = [c.take(at) for c in batch.columns[1:]] + [pa.array(piece, pa.int32())] + [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * with_ids, names=[*keep, *new])

    schema = docs.select(*[f"`{c}`" for c in keep]).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return docs.select(F.col(f"`{text_col}`").alias("__text"), *[f"`{c}`" for c in keep]).mapInArrow(run, schema.add("ids", "binary") if with_ids else schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length by best-fit decreasing; lengths come in descending order."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has exactly r places left
    bins, offsets, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        fit = open_rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms ^= 1 << room
        else:
            b, room, used = used, capacity, used + 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - n:
            rooms[left].append(b)
            open_rooms |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound on bins of three families of dual feasible functions."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    half = capacity // 2
    for e in range(1, half + 1):  # sizes over capacity - e count whole, those under e not at all
        value = np.where(size > capacity - e, capacity, np.where(size < e, 0, size))
        best = max(best, -(-int((count * value).sum()) // capacity))
        # sizes over a half count whole less the parts of size e that fit beside them
        f = capacity // e
        value = np.where(2 * size > capacity, 2 * (f - (capacity - size) // e), np.where(2 * size == capacity, f, np.where(size >= e, 2 * (size // e), 0)))
        best = max(best, -(-int((count * value).sum()) // (2 * f)))
    for k in range(1, 33):  # u(k): round (k + 1) x up and down, whole multiples stay
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def _pack(capacity: int, last: bool, names: list[str]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("rid", "ascending"), ("piece", "ascending")])
        lengths = table["length"].to_numpy()
        bins, offsets = best_fit(lengths, capacity)
        used = int(bins.max()) + 1
        gap = used - lower_bound(lengths, capacity)
        open_ = np.zeros(used, bool)
        if gap and not last:
            fill = np.bincount(bins, weights=lengths, minlength=used)
            emptiest = np.argsort(fill, kind="stable")[: max(8, 4 * gap)]
            open_[emptiest] = fill[emptiest] < capacity
        new = {"bin": pa.array(bins), "offset": pa.array(offsets), "open": pa.array(open_[bins]), "gap": pa.array(np.full(len(bins), gap, np.int32))}
        return pa.table({c: new[c] if c in new else table[c] for c in names})

    return run


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """pieces (with piece and length) and sequence_id, offset, certified: sequences of at most capacity, gapless from 0.

    certified: whether the group that made the sequence has no more of them than its lower
    bound.  Defined results: equal lengths are ordered by a hash of the row; repeated rows
    are packed as often as they come, and spread like others; lengths must be 1 to capacity
    (others raise); columns named as the new ones are replaced; an empty table gives an
    empty result.  Rows gather in groups of about GROUP pieces, and later only the emptiest
    sequences of groups move.
    """
    ship(pieces.sparkSession)
    new = ("sequence_id", "offset", "certified")
    keep = [c for c in pieces.columns if c not in new]
    # a written table: rows are numbered alike when a task is run again
    stored = pieces if hasattr(pieces, "_cut_path") else cut(pieces.select(*[f"`{c}`" for c in keep]), "pieces")
    named = stored.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    length, piece = F.col(f"c{keep.index('length')}"), F.col(f"c{keep.index('piece')}")
    own = [f"c{i}" for i in range(len(keep))]
    checked = named.withColumn("length", F.when(length.between(1, capacity), length).otherwise(F.raise_error(F.lit("a length is not from 1 to the capacity"))).cast("long"))
    whole = checked.where(F.col("length") == capacity).select(*own, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    rest = checked.where(F.col("length") < capacity).withColumn("rid", row_id(*own)).withColumn("piece", piece.cast("int"))
    groups, turn, done = max(1, -(-rest.count() // GROUP)), 0, [whole]
    names = [*own, "length", "rid", "piece", "grp", "bin", "offset", "open", "gap"]
    types = {f.name: f.dataType.simpleString() for f in named.schema.fields}
    schema = ", ".join(f"{c} {types.get(c) or {'length': 'long', 'rid': 'long', 'piece': 'int', 'grp': 'int', 'bin': 'long', 'offset': 'long', 'open': 'boolean', 'gap': 'int'}[c]}" for c in names)
    last = groups == 1
    while True:
        now = rest.select(*own, "length", "rid", "piece", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(groups)).cast("int").alias("grp"))
        packed = cut(now.groupBy("grp").applyInArrow(_pack(capacity, last, names), schema), "packed")
        # numbers below 0: turn, group and bin; from 0: full pieces
        number = -1 - (F.lit(turn << 57) + F.shiftleft(F.col("grp").cast("long"), 26) + F.col("bin"))
        done.append(packed.where("not open").select(*own, number.alias("sequence_id"), "offset", (F.col("gap") == 0).alias("certified")))
        if last:
            break
        rest, before = packed.where("open"), groups
        groups, turn = max(1, -(-rest.count() // GROUP)), turn + 1
        last = groups == 1 or groups > before // 2 or turn == MOST_ROUNDS
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *new)


def pack_documents(docs: DataFrame, path: str, text_col: str = "text", capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """The token pieces of docs, packed; tokenized once, into a table of the shared folder."""
    return pack(cut(token_pieces(docs, path, text_col, capacity, with_ids=with_ids), "pieces"), capacity)


__all__ = ["best_fit", "lower_bound", "pack", "pack_documents", "token_pieces"]
