"""Toxicity by noisy-channel deobfuscation.

A character language model (trigrams of letters, counted over all documents) and a
channel (look-alike digits and signs, letters drawn out, letters set apart) span a
lattice of readings for each disguised token; Viterbi search picks the likeliest.  The
restored text is scored by evidence of its words and word beginnings, learnt from
labelled texts, and a logistic curve makes the strongest evidence a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .infra import cut, ship, slices, working
from .labelled import logistic, probability, training_sample
from .wordhash import chunks

#: What a sign may stand for; fixed values.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "µ": "u", "§": "s", "%": "", "#": "h"}
#: Signs that may stand for any letter, or for nothing.
BLANKS = "*.-_~'`^%#&=/\\,:;"
#: Scores are multiples of this, so that their sums are exact in either precision and do not hang on the order of terms.
GRAIN = 2.0**-14
_grain = lambda x: np.round(np.asarray(x) / GRAIN) * GRAIN
#: Natural logarithms of what the channel does: a look-alike, a sign put in, a letter repeated or hidden.
LOOK, PUT_IN, REPEAT, HIDDEN = (float(_grain(x)) for x in (-0.7, -1.0, -0.4, -4.5))
#: What a blank inside a word costs, between longer pieces and beside a single letter; one that is a word border costs what the language model says.
SPLIT, SPLIT_ONE = -4.0, -1.0
#: A letter that comes just twice is seldom drawn out.
TWICE = -12.0
_N = 28  # a border, a to z, any other letter
_SIGN = 28  # what is neither letter nor blank
#: Deviations by which evidence must exceed chance.
SURE = 3.5
#: Tokens and stretches that a worker remembers; past that it starts anew (results don't depend on it).
CACHE, STRETCHES = 60_000, 120_000
#: Stretches alike, up to the letters around them, from which a table of all surroundings pays, and tables held at most (nor on these).
OFTEN, TABLES = 4000, 64
#: Characters of texts that are restored together; steps of a search whose scores are held at a time.
TOGETHER, STEPS = 1 << 19, 1024
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_TRIM = "\"'.,;:!?()[]{}<>|*#&%$@~-_`^/\\"
_DRAWN = re.compile(r"([^\W\d_])\1\1")
_ODD = re.compile(r"[\W\d_µ]|([^\W\d_])\1\1")
#: What may be decoration at the ends of a token, beside all of its signs.
_OPENING, _CLOSING, _STOPS = "[({<\"'", ".,;:?!)]}>\"'", "\"'.,;:?!()"
#: Runs of three and more single characters set apart; separators and characters are disjoint classes, so matching is linear.
_SPACED = re.compile(r"(?<![^\s.*_-])[^\s.*_-](?:[ \t.*_-]++[^\s.*_-](?![^\W\d_]{2})){2,}(?!\w)")
#: Two and more letters, each unlike the next: whatever stands before them, the search has one state after them.
_CHAIN = re.compile(r"(?:([^\W\d_µ])(?!\1)(?=[^\W\d_µ]))+[^\W\d_µ]")
_LETTER = re.compile(r"[^\W\d_µ]")
_UNITS = re.compile(r"\s+|\S")
_RUN = re.compile(r"(.)\1\1+")
#: Of a longer run the search holds these and how many more there are.
_LONG_RUN = re.compile(r"((\S)\2{63})(\2+)")
_WORDS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """By code point: 0 a blank, 1 to 26 the letters a to z of either case, 27 another letter, _SIGN anything else."""
    kind = np.full(0x110000, _SIGN, np.uint8)
    for i in range(0x110000):
        x = chr(i)
        if x.isalnum() or x.isspace():
            kind[i] = 27 if _LETTER.match(x) else 0 if x.isspace() else _SIGN
    kind[97:123] = kind[65:91] = np.arange(1, 27)
    return kind


@lru_cache(maxsize=2)
def _among(signs: str) -> np.ndarray:
    """By code point: whether it is one of the signs."""
    out = np.zeros(0x110000, bool)
    out[[ord(x) for x in signs]] = True
    return out


def _clear() -> None:
    for f in (_kinds, _classes, _among, _options, _costs):
        f.cache_clear()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kind = _kinds().astype(np.int32)
    return np.where(kind == _SIGN, 0, kind).astype(np.int32)


def letter_classes(text: str) -> np.ndarray:
    """The class of each character: 0 a border (all that is no letter), 1 to 26 the letters a to z of either case, 27 another letter."""
    return _classes()[_points(text)]


def letter_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of letter trigrams over all documents: summed in each task, then by trigram (a table of fixed size)."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("toxicity", _clear)
        total = np.zeros(_N**3, np.int64)
        for b in batches:
            for _, part in chunks((x or "" for x in b.column(0).to_pylist()), 1 << 20):
                c = letter_classes("  " + "  ".join(part) + "  ")
                total += np.bincount((c[:-2] * _N + c[1:-1]) * _N + c[2:], minlength=_N**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["gram", "n"])

    out = np.zeros(_N**3, np.int64)
    for r in docs.select(F.col(f"`{text_col}`")).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r["gram"]] = r["n"]
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a b), by interpolation of trigram, bigram and single counts; to multiples of GRAIN."""
    three = counts.reshape(_N, _N, _N).astype(float)
    two = three.sum(0)
    one = two.sum(0)
    p1 = (one + 1) / (one + 1).sum()
    p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
    return _grain(np.log((three + 20 * p2[None]) / (three.sum(2, keepdims=True) + 20)))


class Trigrams(list):
    """A language model as nested lists, which are quick to look up, and as arrays; with what was decoded last."""

    table: np.ndarray
    single: np.ndarray
    by_last: np.ndarray
    exact: np.ndarray
    found: tuple[dict[str, str | bool], dict[str, str | bool], dict[str, str | bool]]
    seen: Counter
    tables: dict[int, tuple[str, np.ndarray]]

    @classmethod
    def of(cls, lm: list) -> Trigrams:
        if not isinstance(lm, cls):
            lm = cls(lm)
            lm.__setstate__({"table": np.asarray(lm, float)})
        return lm

    def __getstate__(self) -> dict:
        return {"table": self.table}

    def __setstate__(self, state: dict) -> None:
        self.table, self.found, self.seen, self.tables = _grain(state["table"]), ({}, {}, {}), Counter(), {}
        self.single = self.table.astype(np.float32)
        self.by_last = np.ascontiguousarray(self.single.transpose(2, 0, 1))
        self.exact = np.ascontiguousarray(self.table.transpose(0, 2, 1))


@lru_cache(maxsize=4096)
def _options(ch: str, borders: bool = False, split: float = SPLIT) -> list[tuple[str, float]]:
    """What a character may stand for: a letter, nothing ('') or, with borders, a word border (' ')."""
    if _LETTER.match(ch):
        return [(ch, 0.0)]
    if ch.isspace():
        return [(" ", 0.0), ("", split)]
    options = [(x, LOOK) for x in LOOKALIKES.get(ch, "")]
    if ch in BLANKS:
        options += [(x, HIDDEN) for x in _LETTERS] + [("", PUT_IN)]
    elif not options:
        options = [("", PUT_IN)]
    return options + [(" ", 0.0)] * (borders and not category(ch).startswith("M"))


_CLASS_OF = {" ": 0} | {x: i for i, x in enumerate(_LETTERS, 1)}


def _class(x: str) -> int:
    return _CLASS_OF.get(x, 27)


@lru_cache(maxsize=4096)
def _costs(ch: str, again: float, split: float, borders: bool) -> tuple[np.ndarray, np.ndarray, dict[int, str], float]:
    """By class: what it costs to read ch as it, and to stay in a state that ends in it; what each class is read as; the cost of nothing."""
    cost, stay, names, nothing = np.full(_N, -np.inf), np.full(_N, -np.inf), {0: ch}, -np.inf
    for x, c in _options(ch, borders, split):
        if x:
            k = _class(x)
            cost[k], names[k] = max(cost[k], c), x if k else ch
        else:
            stay[:] = nothing = c
    stay[1:27] = np.maximum(stay[1:27], cost[1:27] + again)  # drawn out: no new letter
    return cost, stay, names, nothing


def _distinct(middle: str) -> bool:
    """Whether no letter but a to z comes twice in a stretch: then none can be another one drawn out."""
    other = [x for x in middle if x > "z" and _LETTER.match(x)]
    return len(set(other)) == len(other)


def _stand(items: list[tuple[str, str, str]], lm: Trigrams) -> np.ndarray:
    """For each (two letters, stretch, two letters): whether the likeliest reading of the stretch leaves it as it is.

    The letters of a pair are unlike each other, and no letter of the stretch is like the
    last before or the first after it; stretches have equal numbers of units.  This is the
    search of _all_states for many stretches at once, without the way back.  A reading leaves
    a stretch as it is if it keeps the letters and takes each sign for a border or for
    nothing, and one at least of those between two letters for a border."""
    table, out = lm.single, []
    for part in (items[i : i + 16] for i in range(0, len(items), 16)):
        n = np.arange(len(part))
        a, b, c, d = ([_class(pair[i]) for pair in pairs] for pairs, i in (([x[0] for x in part], 0), ([x[0] for x in part], 1), ([x[2] for x in part], 0), ([x[2] for x in part], 1)))
        c = np.array(c)
        steps = [_steps(x[1]) for x in part]
        best = np.full((len(part), _N, _N), -np.inf, np.float32)
        best[n, a, b] = 0
        kept = best.copy()
        for t in range(len(steps[0][1])):
            cost, stay = (np.array([x[0][t][j] for x in steps], np.float32)[:, None] for j in (0, 1))
            letter = np.array([-1 if x[1][t] is None else x[1][t] for x in steps])
            # a border since the last letter
            close = (letter >= 0) & np.array([t > 0 and x[1][t - 1] is None for x in steps])
            kept[close, :, 1:] = -np.inf
            k = np.maximum(letter, 0)
            moved = (kept + lm.by_last[k]).max(1) + cost[n, 0, k][:, None]
            kept = np.where(letter[:, None, None] >= 0, -np.inf, kept + np.array([x[0][t][3] for x in steps], np.float32)[:, None, None]).astype(np.float32)
            kept[n, :, k] = np.maximum(kept[n, :, k], moved)
            best = np.maximum((best[:, :, :, None] + table).max(1) + cost, best + stay)
        kept[np.array([x[1][-1] is None for x in steps]), :, 1:] = -np.inf
        final = []
        for p in (kept, best):
            q = np.maximum((p + lm.by_last[c]).max(1), np.where((c < 27)[:, None], p[n, :, c] + np.float32(TWICE), -np.inf))
            final.append((q + table[:, c, d].T).max(1))
        out.append(final[0] >= final[1])
    return np.concatenate(out)


def _table(middle: str, lm: Trigrams) -> np.ndarray:
    """_stand of a stretch for all classes of letters around it."""
    one, out, table = np.arange(1, _N), np.zeros((_N, _N, _N, _N), bool), lm.single
    steps, keeps = _steps(middle)
    for a in one:
        scores = []
        for kept in (True, False):
            p = np.full((_N - 1, _N, _N), -np.inf, np.float32)
            p[one - 1, a, one] = 0.0
            p = _after(p, steps, keeps if kept else None, lm)
            q = (p[:, :, :, None] + table).max(1)
            q[:, :, 1:27] = np.maximum(q[:, :, 1:27], p[:, :, 1:27] + np.float32(TWICE))
            scores.append((q[:, :, :, None] + table).max(1))
        out[a, 1:] = scores[0] >= scores[1]
    return out


def _steps(middle: str) -> tuple[list[tuple], list[int | None]]:
    """Costs of each unit of a stretch between letters that it does not hold, and the class of each that is a letter."""
    free = [x for x in _LETTERS if x not in middle]
    units = [free[0], free[1], *_UNITS.findall(middle), free[2], free[3]]
    steps = [_costs(ch, again, split, True) for ch, again, split in zip(units, _drawn(units), _splits(units), strict=True)]
    return steps[2:-2], [_class(ch) if _LETTER.match(ch) else None for ch in units[2:-2]]


def _after(p: np.ndarray, steps: list[tuple], keeps: list[int | None] | None, lm: Trigrams) -> np.ndarray:
    """The scores of all states after the units of a stretch; with keeps, by readings that leave it as it is."""
    for i, (cost, stay, _, nothing) in enumerate(steps):
        q = np.full_like(p, -np.inf)
        letter = None if keeps is None else keeps[i]
        if letter is not None and i and keeps[i - 1] is None:
            p[:, :, 1:] = -np.inf  # a border since the last letter
        for k in np.flatnonzero(np.isfinite(cost)) if keeps is None else [letter or 0]:
            q[:, :, k] = (p + lm.by_last[k]).max(1) + np.float32(cost[k])
        p = np.maximum(q, p + stay.astype(np.float32)) if keeps is None else q if letter is not None else np.maximum(q, p + np.float32(nothing))
    if keeps and keeps[-1] is None:
        p[:, :, 1:] = -np.inf
    return p


def _step(p: np.ndarray, cost: np.ndarray, stay: np.ndarray, lm: Trigrams) -> np.ndarray:
    """The scores of all states after one unit."""
    some = np.flatnonzero(np.isfinite(cost))
    if len(some) < 12:
        moved = np.full((_N, _N), -np.inf)
        for k in some:
            moved[:, k] = (p + lm.exact[:, k]).max(0) + cost[k]
    else:
        moved = (p[:, None] + lm.exact).max(0).T + cost
    return np.maximum(moved, p + stay)


def _steady(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether q is p but for one number added to all: then the same unit once more does the same again."""
    held = np.isfinite(p)
    if not np.array_equal(held, np.isfinite(q)):
        return False
    d = q[held] - p[held]
    return bool((d == d[:1]).all())


def _all_states(states: dict, units: list[str], often: dict[int, int], drawn: list[float], splits: list[float], i: int, lm: Trigrams, borders: bool, end: float) -> tuple:
    """The rest of a search from unit i on, over the array of all states; what is read, as a linked list.

    often: how many stand for a unit in the midst of its run.  Runs of one unit end as soon as a step only adds a number to all scores, which is exact
    (scores are multiples of GRAIN), so a long run costs as much as a short one.  Scores are
    held for STEPS steps and, of those before, every STEPS steps; the way back makes the
    others again and looks for one predecessor a step."""
    p, table = np.full((_N, _N), -np.inf), lm.table
    for k, (q, _, _) in states.items():
        p[k] = q
    other = next((last for (_, b), (_, _, last) in states.items() if b == 27), "")  # the same in all of them
    runs: list[list] = []
    last: tuple = ()
    for at, (ch, again, split) in enumerate(zip(units[i:], drawn[i:], splits[i:], strict=True), i):
        cost, stay, names, nothing = _costs(ch, again, split, borders)
        same = 27 in names and names[27] == other
        if last == (ch, again, split, same):
            runs[-1][1] += often.get(at, 1)
            continue
        last = (ch, again, split, same)
        if same:
            stay = stay.copy()
            stay[27] = max(stay[27], cost[27] + again)
        other = names.get(27, other)
        runs.append([(cost, stay, names, nothing, ch), 1])

    def onward(p: np.ndarray, at: int, done: int) -> tuple[list[tuple], np.ndarray, int, int]:
        trail: list[tuple] = []
        while at < len(runs) and len(trail) < STEPS:
            step, count = runs[at]
            q = _step(p, step[0], step[1], lm)
            times = count - done if count - done > 1 and _steady(p, q) else 1
            trail.append((p, step, times))
            p, done = q, done + times
            if done == count:
                at, done = at + 1, 0
        return trail, p, at, done

    starts, trail, at, done = [], [], 0, 0
    while at < len(runs):
        starts.append((p, at, done))
        trail, p, at, done = onward(p, at, done)
    b, c = divmod(int((p + end * table[:, :, 0]).argmax()), _N)
    read: list[str] = []
    for n, start in enumerate(reversed(starts)):
        for q, (cost, stay, names, nothing, ch), times in reversed(onward(*start)[0] if n else trail):
            while times:
                wide = q[:, b] + table[:, b, c]
                a = int(wide.argmax())
                idle = q[b, c] + stay[c] >= wide[a] + cost[c]
                alike = times if idle or a == b == c else 1  # from the same state: so are all before it in the run
                read.append(names[c] * alike if not idle else "" if stay[c] > nothing else "\0" + ch * alike)
                times -= alike
                if not idle:
                    b, c = a, b
    out = states[b, c][1]
    for x in reversed(read):
        out = (out, x)
    return out


def _units(text: str) -> tuple[list[str], dict[int, int]]:
    """The characters of a text, blanks in a row as one; of long runs 64, with how often the one in their middle stands, by its place."""
    units: list[str] = []
    often, done = {}, 0
    for m in _LONG_RUN.finditer(text):
        units += _UNITS.findall(text[done : m.start()])
        often[len(units) + 32] = 1 + len(m[3])
        units += m[1]
        done = m.end()
    return units + _UNITS.findall(text[done:]), often


def _drawn(units: list[str]) -> list[float]:
    """What it costs to read each unit as the letter before it once more: letters count as drawn out in runs of three, whatever signs are between."""
    out = [REPEAT if units[max(0, i - 2) : i + 3].count(ch) >= 3 else TWICE for i, ch in enumerate(units)]
    at = [i for i, ch in enumerate(units) if _LETTER.match(ch)]
    solid = "".join(units[i] for i in at)
    for i in at:
        out[i] = TWICE
    for m in _RUN.finditer(solid):
        for i in at[m.start() : m.end()]:
            out[i] = REPEAT
    return out


def _splits(units: list[str]) -> list[float]:
    """What it costs to read each unit, if it is a blank, as nothing."""
    solid = [False, *(u not in BLANKS and not u.isspace() for u in units), False]
    alone = [False, *(solid[i] and not solid[i - 1] and not solid[i + 1] for i in range(1, len(solid) - 1)), False]
    return [SPLIT_ONE if alone[i] or alone[i + 2] else SPLIT for i in range(len(units))]


def _search(before: str, middle: str, after: str, lm: Trigrams, borders: bool) -> str:
    """The likeliest reading of middle and the first letter of after, between two letters of a chain (or none: a border).

    The search is exact: it keeps every state, of which there are at most _N * _N."""
    # last two classes -> log-probability, what is read (the last sign and those before), last letter read
    states = {(_class(before[0]), _class(before[1])) if before else (0, 0): (0.0, None, before[-1:])}
    inner, often = _units(middle)
    units, end = [*before, *inner, *after], 0.0 if after else 1.0
    costs, splits, class_of = _drawn(units), _splits(units), _CLASS_OF.get
    for i in range(len(before), len(units)):
        ch, drawn = units[i], costs[i]
        options = _options(ch, borders, splits[i])
        if len(states) * len(options) > 300 or units[i : i + 16] == [ch] * 16:
            at = _all_states(states, units, {len(before) + k: n for k, n in often.items()}, costs, splits, i, lm, borders, end)
            break
        new: dict = {}
        for (a, b), (p, out, last) in states.items():
            row = lm[a][b]
            for x, cost in options:
                if not x:
                    key, value = (a, b), (p + cost, (out, "\0" + ch), last)
                else:
                    c = class_of(x, 27)
                    key, value = (b, c), (p + cost + row[c], (out, x if c else ch), x)
                    if x == last and c:  # drawn out: no new letter
                        k, v = (a, b), (p + cost + drawn, out, last)
                        if k not in new or new[k][0] < v[0]:
                            new[k] = v
                if key not in new or new[key][0] < value[0]:
                    new[key] = value
        states = new
    else:
        at = max(((p + end * lm[a][b][0], out) for (a, b), (p, out, _) in states.items()), key=lambda x: x[0])[1]
    read = []
    while at:
        at, x = at
        read.append(x)
    read = [x for x in reversed(read) if x][: -1 if after else None]
    # a sign that is read as nothing goes from within a word only
    kept, left, right = [], bool(before), bool(after)
    inside = []
    for x in reversed(read):
        right = right if x[0] == "\0" else bool(_LETTER.match(x))
        inside.append(right)
    for x, r in zip(read, reversed(inside), strict=True):
        if x[0] != "\0":
            left = bool(_LETTER.match(x))
            kept.append(x)
        elif borders and not (left and r):
            kept.append(x[1:])
    return "".join(kept)


def _stretches(texts: list[str], lm: Trigrams) -> list[list[list[int]]]:
    """Of each text, [start, end, next, easy] of what lies between pairs of unlike letters, wherever it may be read otherwise than it stands.

    After two unlike letters the search has one state, so what lies between two such pairs
    is decided for itself: text[start:end], given two letters before and two from end on
    (next is 0 or 2: how many of those there are).  Double letters, blanks and what there is
    a table for are settled for all places at once; easy ones among the others can be, by
    _stand."""
    whole = "\0".join(texts)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    u = _points(whole)
    k = _kinds()[u]
    letter = (k >= 1) & (k <= 27)
    pin = np.flatnonzero(letter[1:] & letter[:-1] & (u[1:] != u[:-1])) + 1
    of = np.searchsorted(bounds, pin, side="right") - 1
    gap = np.flatnonzero((np.diff(pin) > 1) & (of[1:] == of[:-1]))
    s, e, of_gap = pin[gap], pin[gap + 1], of[gap]
    a, b, c, d = k[s - 1].astype(np.int64), k[s].astype(np.int64), k[e - 1].astype(np.int64), k[e].astype(np.int64)
    t, known = lm.table, (b < 27) | (c < 27) | (u[s] != u[e - 1])  # a letter may be drawn out if it is the same
    double = (e == s + 2) & (t[a, b, b] + t[b, b, d] >= t[a, b, d] + TWICE)
    blank = known & (e == s + 3) & (k[s + 1] == 0)
    blank &= t[a, b, 0] + t[b, 0, c] + t[0, c, d] >= SPLIT + np.maximum(t[a, b, c] + t[b, c, d], np.where(b == c, TWICE + t[a, b, d], -np.inf))
    left = np.flatnonzero(~(double | blank))
    s, e, a, b, c, d = (x[left] for x in (s, e, a, b, c, d))
    easy, size = known[left] & (e - s > 2) & (e - s < 34), e - s - 2
    # short ones by tables: up to four characters of 16 bits make a number
    code = np.zeros(len(s), np.uint64)
    for i in range(4):
        code |= np.where(i < size, u[np.minimum(s + 1 + i, len(u) - 1)], 0).astype(np.uint64) << np.uint64(16 * i)
    small, stay = np.flatnonzero(easy & (size <= 4) & (int(u.max(initial=0)) < 1 << 16)), np.zeros(len(s), bool)
    small = small[np.argsort(code[small], kind="stable")]
    numbers, first = np.unique(code[small], return_index=True)
    for number, i, j in zip(numbers.tolist(), first.tolist(), [*first[1:].tolist(), *[len(small)] * (len(small) > 0)], strict=True):
        at, known_as = small[i:j], lm.tables.get(number)
        if known_as is None:
            lm.seen[number] += j - i
            middle = whole[s[at[0]] + 1 : e[at[0]] - 1]
            if lm.seen[number] < OFTEN or len(lm.tables) >= TABLES or not _distinct(middle):
                continue
            known_as = lm.tables[number] = middle, _table(middle, lm)
        middle, table = known_as
        ok = table[a[at], b[at], c[at], d[at]]
        for x in filter(_LETTER.match, middle):
            ok &= (u[s[at]] != ord(x)) & (u[e[at] - 1] != ord(x))
        stay[at] = ok
    rest = np.flatnonzero(~stay)
    of_gap, base = of_gap[left][rest], bounds[of_gap[left][rest]]
    rows = np.stack((s[rest] + 1 - base, e[rest] - 1 - base, np.full(len(rest), 2), easy[rest]), 1).tolist()
    ends, lo, hi = np.searchsorted(of_gap, np.arange(len(texts) + 1)), np.searchsorted(of, np.arange(len(texts))), np.searchsorted(of, np.arange(len(texts)), side="right")
    out = []
    for i, text in enumerate(texts):
        mine = rows[ends[i] : ends[i + 1]]
        if lo[i] == hi[i]:
            out.append([[0, len(text), 0, 0]] if text else [])
            continue
        start, stop = int(pin[lo[i]] - bounds[i]), int(pin[hi[i] - 1] - bounds[i])
        head = [[0, start - 1, 2, 0]] if start > 1 else []
        out.append(head + mine + ([[stop + 1, len(text), 0, 0]] if stop + 1 < len(text) else []))
    return out


def _short_stretches(text: str) -> list[list[int]]:
    """The same for a token: all that lies between pairs of unlike letters."""
    end, out = 0, []
    for m in _CHAIN.finditer(text):
        if m.start() > end or end:
            out.append([end, m.start(), 2, 0])
        end = m.end()
    return out if end and end == len(text) else [*out, [end, len(text), 0, 0]]


def _key(text: str, start: int, end: int, after: int) -> str:
    return f"{text[max(0, start - 2) : end + after]}{'' if start else chr(0)}{after}"


def _settle(texts: list[str], stretches: list[list[list[int]]], lm: Trigrams) -> None:
    """Remembers which easy stretches of the texts, not seen before, are to be left as they are."""
    found, fresh = lm.found[2], {}
    if len(found) >= STRETCHES:
        found.clear()
    for text, mine in zip(texts, stretches, strict=True):
        for start, end, after, easy in mine:
            if easy and (key := _key(text, start, end, after)) not in found and key not in fresh:
                fresh[key] = (text[start - 2 : start], text[start:end], text[end : end + 2])
    by: dict[int, list[str]] = {}
    for key, (before, middle, after) in fresh.items():
        if before[1] not in middle and after[0] not in middle and _distinct(middle):
            by.setdefault(len(_UNITS.findall(middle)), []).append(key)
    for keys in by.values():
        found.update((x, False) for x, stays in zip(keys, _stand([fresh[x] for x in keys], lm).tolist(), strict=True) if stays)


def _read(shown: str, text: str, stretches: list[list[int]], lm: Trigrams, borders: bool, settled: bool = False) -> str:
    found, out, done = lm.found[2 if settled else borders], [], 0  # what _settle remembers serves no other search
    for start, end, after, _ in stretches:
        key = _key(text, start, end, after)
        got = found.get(key)
        if got is None:
            got = _search(text[start - 2 : start] if start else "", text[start:end], text[end : end + after], lm, borders)
            got = False if got == text[start : end + (after > 0)] else got
            if end - start < 30:
                if len(found) >= STRETCHES and not settled:
                    found.clear()
                found[key] = got
        if got is not False:
            out += shown[done:start], got
            done = end + (after > 0)
    return "".join((*out, shown[done:])) if out else shown


def restored(texts: list[str], lm: list) -> list[str]:
    """The texts with their disguised words restored; signs, blanks and capitals that are no disguise stay.

    Letters between pairs of unlike letters are searched for one stretch after the other,
    which gives what a search of a whole text gives.  Time is linear in the text."""
    lm = Trigrams.of(lm)
    low = [t.lower() for t in texts]
    stretches = _stretches(low, lm) if low else []
    _settle(low, stretches, lm)
    return [_read(x if len(x) == len(y) else y, y, st, lm, True, True) for x, y, st in zip(texts, low, stretches, strict=True)]


def restore(text: str, lm: list, borders: bool = False) -> str:
    """The likeliest letters behind a token ('' if there are none); with borders, a text restored."""
    lm = Trigrams.of(lm)
    return restored([text], lm)[0] if borders else _read(text, text, _short_stretches(text), lm, False)


def readings(token: str, lm: list) -> list[str]:
    """The words a token may hold: its letters as they stand and, if it has a sign, a digit or a letter drawn out, restored.

    Signs at its ends are read both ways, as decoration and as parts of the word."""
    token = token.lower()
    plain = token.strip(_TRIM)
    if not _ODD.search(token):
        return [plain]
    lm = Trigrams.of(lm)
    bare = next((i for i, ch in enumerate(token) if ch.isalnum()), len(token))
    lefts = {0, len(token) - len(token.lstrip(_OPENING)), bare}
    rights = {len(token), len(token.rstrip(_CLOSING)), next((i for i in range(len(token), 0, -1) if token[i - 1].isalnum()), 0)}
    found = [restore(x, lm) if _ODD.search(x) else x for x in (token[i:j] for i in sorted(lefts) for j in sorted(rights) if i < j)]
    found += _WORDS.findall(_read(token, token, _short_stretches(token), lm, True))
    return list(dict.fromkeys(found + [plain] * plain.isalpha()))


def spaced(text: str) -> list[str]:
    """Runs of three and more single characters set apart, each as one token; the lattice reads their blanks too, as borders or not."""
    apart = np.concatenate(([True], _among(" \t\n\r.*_-")[_points(text)], [True]))
    edge = np.flatnonzero(apart[1:] != apart[:-1])  # bounds of what stands between separators
    single = (edge[1:] - edge[:-1])[::2] == 1
    if not (single[2:] & single[1:-1] & single[:-2]).any():
        return []
    return [re.sub(r"[ \t]+", "", m) for m in _SPACED.findall(text)]


def odd_tokens(text: str, u: np.ndarray | None = None) -> set[str]:
    """Tokens with a sign or a digit, but for stops and quotes at their ends, or with a letter drawn out; u: the text's code points."""
    if not text:
        return set()
    u = _points(text) if u is None else u
    k = _kinds()[u]
    letter = (k >= 1) & (k <= 27)
    odd = k == _SIGN
    stop = _among(_STOPS)[u]
    stop[1:] &= letter[:-1]
    stop[:-1] &= k[1:] != 0
    stop[0] = stop[-1] = False
    odd &= stop | ~_among(_STOPS)[u]
    same = u[1:] == u[:-1]
    odd[2:] |= same[1:] & same[:-1] & letter[2:]
    at = np.flatnonzero(odd)
    if not len(at):
        return set()
    blank = np.concatenate(([-1], np.flatnonzero(k == 0), [len(text)]))
    ends = np.unique(np.searchsorted(blank, at))
    found = {text[i:j] for i, j in zip((blank[ends - 1] + 1).tolist(), blank[ends].tolist(), strict=True)}
    return {t for t in found if not t.strip(_STOPS).isalpha() or _DRAWN.search(t) or "µ" in t}


def grams(word: str) -> list[str]:
    """The features of a word: itself and its beginnings of four to six letters."""
    return [word + "$", *(word[:k] for k in (4, 5, 6) if len(word) >= k)] if len(word) >= 3 else []


def words_of(text: str, fixed: str, lm: list) -> set[str]:
    """All words of a text, in lower case: as they stand, as the lattice restored the text, and the readings of odd tokens and of letters set apart."""
    words = {w.lower() for w in _WORDS.findall(text)} | {w.lower() for w in _WORDS.findall(fixed)}
    for t in odd_tokens(text):
        words.update(readings(t, lm))
    for t in spaced(text):
        for w in (t, t[1:], t[:-1]):  # a one-letter word may stand beside a run
            words.update(readings(w, lm))
    return words


@dataclass
class ToxicityModel:
    lm: list
    evidence: dict[str, float]
    curve: tuple[np.ndarray, np.ndarray, np.ndarray]
    cache: dict[str, tuple[float, str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.lm = Trigrams.of(self.lm)
        self.starts = {g[:3] for g in self.evidence}
        self.begins = np.zeros(_N**3, bool)
        for g in self.starts:
            x, y, z = (_class(c) for c in g)
            self.begins[(x * _N + y) * _N + z] = True

    def __getstate__(self) -> dict:
        return {"lm": self.lm, "evidence": self.evidence, "curve": self.curve}

    def __setstate__(self, state: dict) -> None:
        self.lm, self.evidence, self.curve, self.cache = state["lm"], state["evidence"], state["curve"], {}
        self.__post_init__()

    def of_word(self, word: str) -> float:
        get = self.evidence.get
        return max((get(g, 0.0) for g in grams(word)), default=0.0)

    def of_token(self, token: str) -> tuple[float, str]:
        """The strongest evidence in the readings of an odd token, and the word that holds it."""
        found = self.cache.get(token)
        if found is None:
            if len(self.cache) > CACHE:
                self.cache.clear()
            found = self.cache[token] = max(((self.of_word(w), w) for w in readings(token, self.lm)), default=(0.0, ""))
        return found

    def _candidates(self, text: str, u: np.ndarray) -> set[str]:
        """The words of a text, in lower case, that begin like a feature with evidence does; others have none."""
        c = np.zeros(len(u) + 4, np.int32)
        c[1:-3] = _classes()[u]
        start = np.flatnonzero((c[:-3] == 0) & (c[1:-2] > 0))
        start = start[self.begins[(c[start + 1] * _N + c[start + 2]) * _N + c[start + 3]]]
        if not len(start):
            return set()
        stop = np.flatnonzero(c == 0)
        stop = stop[np.searchsorted(stop, start + 1)]
        return {text[i:j].lower() for i, j in zip(start.tolist(), (stop - 1).tolist(), strict=True)}

    def features(self, text: str, fixed: str | None = None) -> np.ndarray:
        """The three strongest evidences of distinct words, and how many there are and their share (as logarithms); fixed: the text as restored."""
        fixed = restore(text, self.lm, True) if fixed is None else fixed
        tokens, u = set(text.split()), _points(text)
        words = self._candidates(text, u)
        if fixed is not text and (changed := " ".join(set(fixed.split()) - tokens)):
            words |= self._candidates(changed, _points(changed))
        held = {w: self.of_word(w) for w in words}
        for t in odd_tokens(text, u):
            x = t[:3].lower()
            # three letters, each unlike the next, are read as they stand
            if len(x) == 3 and x.isalpha() and x[0] != x[1] != x[2] and x not in self.starts and "µ" not in x:
                continue
            e, w = self.of_token(t)
            held[w] = e
        for t in spaced(text):
            for x in (t, t[1:], t[:-1]):
                e, w = self.of_token(x)
                held[w] = e
        strong = sorted((e for e in held.values() if e > 0), reverse=True)
        top = (strong + [0.0, 0.0, 0.0])[:3]
        return np.array([*top, np.log1p(len(strong)), np.log1p(100 * len(strong) / (len(tokens) + 20))])

    def all_features(self, texts: list[str]) -> np.ndarray:
        rows = [self.features(t, f) for _, part in chunks(texts, TOGETHER) for t, f in zip(part, restored(part, self.lm), strict=True)]
        return np.array(rows).reshape(len(texts), 5)


def _evidence(sample: DataFrame, lm: list) -> dict[str, float]:
    """Features that toxic texts of the first fold hold more often than others, with their weight; counted in tasks, then by feature."""
    held = sample.sparkSession.sparkContext.broadcast(lm)  # a trigram table of fixed size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("toxicity", _clear)
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            labels = b.column(1).to_pylist()
            for at, part in chunks(b.column(0).to_pylist(), TOGETHER):
                for text, fixed, y in zip(part, restored(part, held.value), labels[at : at + len(part)], strict=True):
                    seen[y].update({g for w in words_of(text, fixed, held.value) for g in grams(w)})
                    if len(seen[y]) > 50_000:
                        yield told(seen, y)
        yield told(seen, 0)
        yield told(seen, 1)

    def told(seen: dict[int, Counter], y: int) -> pa.RecordBatch:
        n, seen[y] = seen[y], Counter()
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([y] * len(n), pa.int32()), pa.array(list(n.values()), pa.int64())], names=["gram", "y", "n"])

    first = sample.where("f = 0")
    ones, zeros = F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0))
    counts = cut(first.select("text", "y").mapInArrow(count, "gram string, y int, n long").groupBy("gram").agg(ones.alias("k"), zeros.alias("k0")), "grams")
    sums = counts.agg(F.sum("k").alias("k"), F.sum("k0").alias("k0")).first()
    # documents of each class that hold the feature, with a prior that keeps rare ones silent,
    # against what any feature's share is: toxic texts may just be longer
    e = F.log((F.col("k") + 0.5) / ((sums["k"] or 0) + 1)) - F.log((F.col("k0") + 1.0) / ((sums["k0"] or 0) + 1))
    sure = F.col("e") >= SURE * F.sqrt(1 / (F.col("k") + 0.5) + 1 / (F.col("k0") + 1.0))
    strong = counts.where("k >= 3").withColumn("e", e).where("e > 1.5").where(sure)
    return {r["gram"]: r["e"] * r["k"] / (r["k"] + 2) for r in strong.collect()}  # of a bounded sample


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 3000) -> ToxicityModel:
    """The language model of all documents; evidence and curve from a sample of at most `most` labelled rows a class.

    Texts stay in tasks: the driver sees counts of features and one row of numbers a
    sampled text.  With no labelled rows of a class, every score is one half."""
    lm = Trigrams.of(language_model(letter_counts(docs, text_col)).tolist())
    sample = training_sample(docs, labels, label_col, id_col, text_col, most)
    model = ToxicityModel(lm, _evidence(sample, lm), (np.zeros(6), np.zeros(5), np.ones(5)))
    if model.evidence:
        held = docs.sparkSession.sparkContext.broadcast(model)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = held.value.all_features(b.column(0).to_pylist()).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

        rows = sample.where("f <> 0").select("text", "y").mapInArrow(measure, "x array<double>, y int").collect()
        rows.sort(key=lambda r: (r["y"], r["x"]))
        y = np.array([r["y"] for r in rows], float)
        if 0 < y.sum() < len(y):
            model.curve = logistic(np.array([r["x"] for r in rows]), y)
    return model


def restored_text(text: str, model: ToxicityModel) -> str:
    """The text with its disguised words restored."""
    return restore(text, model.lm, True)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score", threshold: float = 0.7, with_text: bool = False) -> DataFrame:
    """docs with `out` (0 to 1, higher: toxic likelier), predicted (1 from threshold on), and restored if with_text.

    Whole texts are read, however long.  A null or empty text has the score of no
    evidence; columns named as the new ones are replaced; repeated rows get equal scores;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)  # trigram table of fixed size, evidence from a bounded sample
    new = [out, "predicted"] + ["restored"] * with_text
    keep = [c for c in docs.columns if c not in new]
    place = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("toxicity", _clear)
        m = held.value
        for b in slices(batches):
            texts = [x or "" for x in b.column(place).to_pylist()]
            p = probability(m.curve, m.all_features(texts))
            cols = [*b.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            if with_text:
                cols.append(pa.array([t for _, part in chunks(texts, TOGETHER) for t in restored(part, m.lm)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *new])

    thin = docs.select(*[f"`{c}`" for c in keep])
    schema = thin.select("*").schema.add(out, "double").add("predicted", "integer")
    return thin.mapInArrow(run, schema.add("restored", "string") if with_text else schema)
