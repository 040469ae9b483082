"""Long lists of names in text: a text is read once however many names there are.

*Which rows hold which names* (``held``): the list is dealt into parts of bounded size; each
part is broadcast and built once in each worker as an Aho-Corasick automaton.  A list beyond
one part goes by a filter instead.

*How many rows hold a name, and which names are used* (``counted``, ``used``): by a filter of
bounded size, whatever the list.  It holds hashes of all names and of their first 2, 4, 8, 16,
... bytes.  A batch of texts is looked at as one run of bytes, all places at once: a place
stays while the filter has its next 2, 4, 8, ... bytes, and a stretch that it has as a whole
may be a name.  Such stretches are told apart by their bytes, counted where they are found,
and joined with the list, which leaves the names.  Neither texts nor the list travel.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.sources.shared import written

#: Characters of a part of the list at most (some 60 bytes of automaton each), but for one longer name.
PART = 4 << 20

#: Words (of 64 bits) of a filter at most, and names that share one: more are dealt into several, each a pass over the texts.
WORDS, MOST_NAMES = 1 << 22, 1 << 23
#: Bytes of text that are looked at together; candidates that a task holds.
_STRETCH, _KEPT = 1 << 20, 1 << 17

_built: dict[str, object] = {}


def _automaton(key: str, names: Broadcast):
    """The automaton of a broadcast part, kept in this worker until another part comes."""
    import ahocorasick

    if key not in _built:
        _built.clear()
        a = ahocorasick.Automaton()
        for n in names.value:
            a.add_word(n, n)
        a.make_automaton()
        _built[key] = a
    return _built[key]


def _is_word(c: str) -> bool:
    return c == "_" or (c.isascii() and c.isalnum())


def parts(names: DataFrame | Sequence[str], column: str = "name", most: int | None = None) -> Iterator[list[str]]:
    """The distinct names that are neither null nor empty, in parts of at most `most` characters (or one name); the driver holds one part at a time.

    A table is dealt by hash into as many parts as its characters ask for, twice over, and a
    part that came out too large is cut where it is read."""
    most = most or PART
    if isinstance(names, DataFrame):
        one = names.select(F.col(column).cast("string").alias("name")).where("name <> ''").distinct()
        size = one.agg(F.sum(F.length("name")).alias("n")).first()["n"] or 0
        n = max(1, 2 * -(-size // most)) if size > most else 1
        sources = ((r["name"] for r in one.where(F.pmod(F.xxhash64("name"), F.lit(n)) == i).toLocalIterator()) for i in range(n))
    else:
        sources = iter([sorted({x for x in names if x})])
    for source in sources:
        held, size = [], 0
        for name in source:
            if held and size + len(name) > most:
                yield held
                held, size = [], 0
            held.append(name)
            size += len(name)
        if held:
            yield held


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def _closed(state: np.ndarray | int, rest: np.ndarray | int, n: int, whole: bool) -> np.ndarray:
    """The hash of n bytes: state of their full words, rest the bytes behind these; whole: as a name, else as the beginning of one."""
    return _mixed((np.uint64(state) ^ rest) + np.uint64((0x9E3779B97F4A7C15 * (2 * n + whole)) & (2**64 - 1)))


def _first(word: np.ndarray, n: int) -> np.ndarray:
    return word & np.uint64((1 << 8 * n) - 1)


def _bits(h: np.ndarray) -> np.ndarray:
    """The bits of a hash in its word of the filter."""
    one, low = np.uint64(1), np.uint64(63)
    return one << (h & low) | one << (h >> np.uint64(6) & low) | one << (h >> np.uint64(12) & low)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, the eight bytes from each place on as a number, where each text begins and the last ends); a null is an empty text."""
    column = column.fill_null("").cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    n = int(at[-1] - at[0])
    data = np.zeros(n + 16, np.uint8)
    if n:
        data[:n] = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]
    return data, np.ndarray((n + 8,), "<u8", data, strides=(1,)), at - at[0]


def _entries(names: pa.Array) -> np.ndarray:
    """The hashes that a filter holds of names."""
    _, word, at = _bytes_of(names)
    out, sizes = [], np.diff(at)
    for n in np.unique(sizes[sizes > 0]).tolist():
        pos, state = at[:-1][sizes == n], np.zeros(int((sizes == n).sum()), np.uint64)
        out += [_closed(0, _first(word[pos], k), k, False) for k in (2, 4) if k <= n]
        for b in range(n // 8):
            state = _mixed(state ^ word[pos + 8 * b])
            if not b & (b + 1):
                out.append(_closed(state, 0, 8 * (b + 1), False))
        out.append(_closed(state, _first(word[pos + 8 * (n // 8)], n % 8), n, True))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class _Filter:
    """Where in texts a name may stand."""

    def __init__(self, words: np.ndarray, lengths: list[int], whole_word: bool):
        self.words, self.lengths, self.whole_word = words, lengths, whole_word
        self.shift = np.uint64(64 - (len(words).bit_length() - 1))
        every = np.arange(1 << 16, dtype=np.uint64)
        self.one, self.two = self.has(_closed(0, every[:256], 1, True)), self.has(_closed(0, every, 2, False))
        self.sign = np.array([not _is_word(chr(i)) for i in range(256)])

    def has(self, h: np.ndarray) -> np.ndarray:
        word, low = self.words[h >> self.shift], np.uint64(63)
        return ((word >> (h & low)) & (word >> (h >> np.uint64(6) & low)) & (word >> (h >> np.uint64(12) & low)) & np.uint64(1)).astype(bool)

    def places(self, data: np.ndarray, word: np.ndarray, at: np.ndarray, row_of: Callable[[np.ndarray], np.ndarray], begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, bytes, hash, row) of what may be a name and begins in [begin, end); places of the same bytes in their order."""
        here = data[begin:end]
        fit = here & 0xC0 != 0x80  # the others are within a character
        if self.whole_word:
            before = self.sign[data[max(begin - 1, 0) : end - 1]]
            fit[len(here) - len(before) :] &= before
            starts = at[np.searchsorted(at, begin) : np.searchsorted(at, end)] - begin
            fit[starts] = here[starts] & 0xC0 != 0x80
        found = []

        def kept(pos: np.ndarray, n: int, h: np.ndarray, hit: np.ndarray) -> None:
            pos, h = pos[hit], h[hit]
            row = row_of(pos)
            last = at[row + 1]
            ok, behind = pos + n <= last, data[np.minimum(pos + n, len(data) - 1)]
            ends = behind & 0xC0 != 0x80
            ok &= (pos + n == last) | (ends & self.sign[behind] if self.whole_word else ends)
            found.append((pos[ok], np.full(int(ok.sum()), n), h[ok], row[ok]))

        sizes = self.lengths
        if 1 in sizes:
            pos = np.flatnonzero(fit & self.one[here]) + begin
            kept(pos, 1, _closed(0, _first(word[pos], 1), 1, True), np.ones(len(pos), bool))
        pos = np.flatnonzero(fit & self.two[np.ndarray((len(data) - 1,), "<u2", data, strides=(1,))[begin:end]]) + begin
        now = word[pos]
        for low in (2, 4):
            for n in range(low, 2 * low):
                if n in sizes:
                    h = _closed(0, _first(now, n), n, True)
                    kept(pos, n, h, self.has(h))
            if sizes[-1] >= 2 * low:
                go = self.has(_closed(0, _first(now, 2 * low), 2 * low, False)) if low == 2 else self.has(_closed(_mixed(now), 0, 8, False))
                pos, now = pos[go], now[go]
        if sizes[-1] >= 8:
            last = at[row_of(pos) + 1]
            go = pos + 8 <= last
            pos, last, state, low = pos[go], last[go], _mixed(now[go]), 8
            while len(pos) and sizes[-1] >= low:  # each round: names of low to 2 low - 1 bytes, whose first low bytes the filter has
                for n in range(low, 2 * low):
                    if n % 8 == 0 and n > low:
                        go = pos + n <= last
                        pos, last = pos[go], last[go]
                        state = _mixed(state[go] ^ word[pos + n - 8])
                    if n in sizes:
                        go = np.flatnonzero(pos + n <= last)
                        h = _closed(state[go], _first(word[pos[go] + n // 8 * 8], n % 8), n, True)
                        kept(pos[go], n, h, self.has(h))
                low *= 2
                if sizes[-1] >= low:
                    go = pos + low <= last
                    pos, last = pos[go], last[go]
                    state = _mixed(state[go] ^ word[pos + low - 8])
                    go = self.has(_closed(state, 0, low, False))
                    pos, last, state = pos[go], last[go], state[go]
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.uint64, np.int64))

    def candidates(self, column: pa.Array) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
        """By stretches of texts: (what may be names, and rows with the number of a candidate that they hold, each once)."""
        data, word, at = _bytes_of(column)
        row, rows = 0, len(at) - 1
        while row < rows:
            until = max(row + 1, int(np.searchsorted(at, at[row] + _STRETCH, "right")) - 1)
            begin, end = int(at[row]), int(at[until])
            each = np.repeat(np.arange(row, until), np.diff(at[row : until + 1])) if until > row + 1 else None
            row_of = lambda pos, each=each, begin=begin, row=row: np.full(len(pos), row) if each is None else each[pos - begin]
            found = [_once(word, *self.places(data, word, at, row_of, b, min(b + _STRETCH, end))) for b in range(begin, end, _STRETCH)]
            if found:
                pos, size, _, mine, code = found[0] if len(found) == 1 else _once(word, *list(map(np.concatenate, zip(*found, strict=True)))[:4])
                first = np.flatnonzero(np.diff(code, prepend=-1))
                yield [data[p : p + n].tobytes() for p, n in zip(pos[first].tolist(), size[first].tolist(), strict=True)], mine, code
            row = until


def _once(word: np.ndarray, pos: np.ndarray, size: np.ndarray, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, bytes, hash, row, number of what stands there), by number and row: each row's candidates once.  Hashes only bring equals together; bytes tell them apart."""
    order = np.argsort(h, kind="stable")
    pos, size, h, row = pos[order], size[order], h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    code = np.cumsum(new) - 1
    model = pos[new][code]
    if (size != size[new][code]).any() or _differ(word, pos, model, size):
        names: dict[bytes, int] = {}
        code = np.array([names.setdefault(word[p : p + n].astype(np.uint8).tobytes(), len(names)) for p, n in zip(pos.tolist(), size.tolist(), strict=True)], np.int64)
        order = np.lexsort((pos, code))
        pos, size, h, row, code = pos[order], size[order], h[order], row[order], code[order]
    keep = np.ones(len(pos), bool)
    keep[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    return pos[keep], size[keep], h[keep], row[keep], code[keep]


def _differ(word: np.ndarray, pos: np.ndarray, model: np.ndarray, size: np.ndarray) -> bool:
    """Whether the bytes of a place are not those of its model."""
    b = 0
    while len(pos):
        left = np.minimum(size - 8 * b, 8).astype(np.uint64)
        if ((word[pos + 8 * b] ^ word[model + 8 * b]) << (np.uint64(64) - np.uint64(8) * left)).any():
            return True
        b += 1
        more = size > 8 * b
        pos, model, size = pos[more], model[more], size[more]
    return False


def _listed(df: DataFrame, names: DataFrame | Sequence[str], column: str) -> DataFrame:
    """(name): the distinct names that are neither null nor empty, written."""
    if not isinstance(names, DataFrame):
        names, column = df.sparkSession.createDataFrame([(n,) for n in names], "name string"), "name"
    return written(names.select(F.col(column).cast("string").alias("name")).where("name <> ''").distinct(), "names")


def _filters(listed: DataFrame, whole_word: bool) -> Iterator[Broadcast]:
    """(words, lengths, whole_word) of a filter of the names, broadcast: of WORDS words at most; of more than MOST_NAMES names several."""
    spark = listed.sparkSession
    total = listed.count()
    n = -(-total // MOST_NAMES)
    for i in range(n):
        mine = listed.where(F.pmod(F.xxhash64("name"), F.lit(n)) == i)
        lengths = sorted(r["n"] for r in mine.select(F.octet_length("name").alias("n")).distinct().collect())
        words = min(WORDS, 1 << max(10, (total // n).bit_length()))

        def run(batches: Iterator[pa.RecordBatch], shift: int = 64 - (words.bit_length() - 1)) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = _entries(b.column(0))
                yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(shift)).astype(np.int64)), pa.array(_bits(h).view(np.int64))], names=["at", "bits"])

        held = np.zeros(words, np.uint64)
        for b in mine.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow().to_batches():  # a row a word at most
            held[b.column("at").to_numpy()] = b.column("bits").to_numpy().view(np.uint64)
        if lengths:
            yield spark.sparkContext.broadcast((held, lengths, whole_word))


def _filter_of(key: str, parts: Broadcast) -> _Filter:
    """A broadcast filter, kept in this worker until another comes."""
    if key not in _built:
        _built.clear()
        _built[key] = _Filter(*parts.value)
    return _built[key]


def _texts(found: list[bytes]) -> pa.Array:
    return pa.array(found, pa.binary()).view(pa.string())


def counted(df: DataFrame, names: DataFrame | Sequence[str], text: str = "line", whole_word: bool = False, column: str = "name") -> DataFrame:
    """(name, n_rows): how many rows of df hold a name, of the names that one does; names and words as for ``held``."""
    listed, found = _listed(df, names, column), None
    for mine in _filters(listed, whole_word):

        def run(batches: Iterator[pa.RecordBatch], mine: Broadcast = mine, key: str = uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            here, total = _filter_of(key, mine), {}
            told = lambda: pa.RecordBatch.from_arrays([_texts(list(total)), pa.array(list(total.values()), pa.int64())], names=["name", "n"])
            for b in batches:
                for may, _, code in here.candidates(b.column(0)):
                    for name, n in zip(may, np.bincount(code, minlength=len(may)).tolist(), strict=True):
                        total[name] = total.get(name, 0) + n
                    if len(total) > _KEPT:
                        yield told()
                        total.clear()
            yield told()

        part = df.select(F.col(text).cast("string")).mapInArrow(run, "name string, n long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return listed.select("name", F.lit(0).cast("long").alias("n_rows"))
    return found.groupBy("name").agg(F.sum("n").alias("n_rows")).join(listed, "name", "left_semi")


def _held(df: DataFrame, listed: DataFrame, text: str, whole_word: bool) -> DataFrame:
    """``held`` by filters."""
    place, schema, found = df.columns.index(text), df.select("*").schema.add("name", "string"), None
    for mine in _filters(listed, whole_word):

        def run(batches: Iterator[pa.RecordBatch], mine: Broadcast = mine, key: str = uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            here = _filter_of(key, mine)
            for b in batches:
                for may, row, code in here.candidates(b.column(place)):
                    all_names = _texts(may)
                    yield from _taken(b, row, all_names.take(pa.array(code)))

        part = df.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return df.withColumn("name", F.lit(None).cast("string")).where("false")
    return found.join(listed, "name", "left_semi").select(*df.columns, "name")


def _taken(b: pa.RecordBatch, row: Sequence[int], names: pa.Array) -> Iterator[pa.RecordBatch]:
    """The batch's rows with names, in pieces of bounded size: a row is copied for each of its names."""
    each = max(1, int(_STRETCH * 8 // (1 + b.nbytes / max(1, b.num_rows))))
    for i in range(0, max(1, len(row)), each):
        rows = b.take(pa.array(row[i : i + each], pa.int32()))
        yield pa.RecordBatch.from_arrays([*rows.columns, names.slice(i, each)], names=[*b.schema.names, "name"])


def held(df: DataFrame, names: DataFrame | Sequence[str], text: str = "line", whole_word: bool = False, column: str = "name", most: int | None = None) -> DataFrame:
    """df's rows with name: one row for each distinct name that the text holds.

    whole_word: only where no letter, digit or '_' (of ASCII) stands before or behind it.
    Names are taken as they are: signs of patterns mean themselves.  A null text holds
    nothing; an empty list finds nothing."""
    if most is None and isinstance(names, DataFrame):
        names, column = _listed(df, names, column), "name"
        if (names.agg(F.sum(F.length("name")).alias("n")).first()["n"] or 0) > PART:
            return _held(df, names, text, whole_word)
    place, schema = df.columns.index(text), df.select("*").schema.add("name", "string")
    found = None
    for part in parts(names, column, most):
        mine = df.sparkSession.sparkContext.broadcast(part)  # bounded by `most`

        def run(batches: Iterator[pa.RecordBatch], mine: Broadcast = mine, key: str = uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            a = _automaton(key, mine)
            for b in batches:
                at, hits = [], []
                for i, t in enumerate(b.column(place).to_pylist()):
                    if not t:
                        continue
                    if whole_word:
                        seen = {n for end, n in a.iter(t) if not (end + 1 < len(t) and _is_word(t[end + 1])) and not (end >= len(n) and _is_word(t[end - len(n)]))}
                    else:
                        seen = {n for _, n in a.iter(t)}
                    at.extend([i] * len(seen))
                    hits.extend(sorted(seen))
                yield from _taken(b, at, pa.array(hits, pa.string()))

        here = df.mapInArrow(run, schema)
        found = here if found is None else found.unionByName(here)
    return df.withColumn("name", F.lit(None).cast("string")).where("false") if found is None else found


def used(names: DataFrame, texts: DataFrame, text: str, column: str = "name", whole_word: bool = False) -> DataFrame:
    """Rows of names whose name some text holds: a semi-join, in which each task sends a name once."""
    hit = counted(texts, names, text, whole_word, column).select(F.col("name").alias("_hit"))
    return names.join(hit, F.col(column) == F.col("_hit"), "left_semi")
