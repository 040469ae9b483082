"""Conversation structure repair: the cheapest edits that make a dialogue follow the role grammar.

Three weighted automata are composed: an acceptor of the conversation's turns, a transducer
of edits (keep, rerole, delete, insert) and an acceptor of the roles ``(s?(ua)+)?``.  States
of the composition are made as they are reached; its shortest path is found in reverse
topological order over weights (cost, labels), compared by cost and then by label string.
From one state no two arcs have the same label and no arc is free of both label and cost,
so among cheapest paths the first label already decides, and no string has to be compared.

Turns lie in blocks of the global order, so a conversation of any length is worked on by many
tasks: each block gives the cheapest cost between any two states of the grammar, the costs to
go are carried from the last block to the first, each block finds its paths from every
state, and the states met are followed from the first block to the last.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.operators.segments import dealt

from .infra import cut, discard, ship

#: Costs of the edits, and of a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Bits of a block: it holds at most 65,536 turns of a conversation.
BLOCK_BITS = 16

#: The grammar of role initials: start, after s, after u, after a; its arcs, and where it may end.
STATES, ROLES = 4, {"u": "user", "a": "assistant"}
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_FAR = 1 << 60
ACCEPTED = (0, _FAR, _FAR, 0)

#: A turn as a symbol: the initial of its role (o: another), in capitals if it is truncated; x if it has to go.
MUST_GO = "x"

#: Inserts in a row at most: of three the first and the third lead to the same state, so that two of them could be left out.
_INSERTS = 2


def edits(symbol: str) -> Iterator[tuple[str, int, str | None]]:
    """The transducer's arcs that read a symbol: (label, cost, role initial written or None)."""
    yield "D", DELETE, None
    if symbol != MUST_GO:
        extra = TRUNCATED if symbol.isupper() else 0
        yield "K", KEEP + extra, symbol.lower()
        for role in ROLES:
            yield "R", REROLE + extra, role


@lru_cache(maxsize=None)  # 3 * 4 * 10 states and symbols
def arcs(state: tuple[int, int], symbol: str | None) -> tuple[tuple[str, int, tuple[int, int]], ...]:
    """Arcs of the composition that read a symbol (None: those that insert) from (inserts in a row, state of the grammar)."""
    done, at = state
    if symbol is None:
        return tuple(("I", INSERT, (done + 1, to)) for role in ROLES if done < _INSERTS and (to := GRAMMAR.get((at, role))) is not None)
    out = {}
    for label, cost, role in edits(symbol):
        to = at if role is None else GRAMMAR.get((at, role))
        if to is not None:
            out[label] = (label, cost, (0, to))
    return tuple(out.values())


@lru_cache(maxsize=1 << 16)
def _level(reached: frozenset, symbol: str | None) -> tuple[tuple, frozenset]:
    """What a place of the input adds to the composition: (state, arcs) in reverse topological order, and the states reached behind the symbol; None: the end, where inserts may follow."""
    every = set(reached)
    new = list(reached)
    while new:
        for _, _, to in arcs(new.pop(), None):
            if to not in every:
                every.add(to)
                new.append(to)
    table = tuple((s, (*arcs(s, None), *(arcs(s, symbol) if symbol else ()))) for s in sorted(every, key=lambda s: (-s[0], s[1])))
    return table, frozenset(to for _, out in table for _, _, to in out if to[0] == 0)


def _expanded(symbols: str, starts: frozenset, last: bool) -> list[tuple]:
    """The levels of the composition of a stretch, one a symbol; if it is the last, one more for what is inserted at the end."""
    levels, reached = [], starts
    for x in symbols:
        table, reached = _level(reached, x)
        levels.append(table)
    if last:
        levels.append(_level(reached, None)[0])
    return levels


def _relaxed(table: tuple, after: dict, end: tuple | None) -> tuple[dict, dict]:
    """(cost to go, arc taken) by state of a level, from the costs of the level behind it; end: costs of stopping here."""
    cost, taken = {}, {}
    for state, out in table:
        best, arc = (end[state[1]], ("",)) if end is not None else (_FAR, None)
        for a in out:
            label, c, to = a
            c += cost[to] if label == "I" else after.get(to, _FAR)
            if c < best or (c == best < _FAR and label < arc[0]):
                best, arc = c, a
        cost[state], taken[state] = best, arc
    return cost, taken


def shortest(symbols: str, end: tuple = ACCEPTED, last: bool = True, starts: tuple[int, ...] = (0,)) -> list[tuple[int, str, int, int]]:
    """For each start: (cost to the end, labels, state behind them, their own cost) of the cheapest, then least labels; end: what each state costs behind the stretch."""
    levels = _expanded(symbols, frozenset((0, g) for g in starts), last)
    after, path = {(0, g): end[g] for g in range(STATES)}, [None] * len(levels)
    for i in range(len(levels) - 1, -1, -1):
        after, path[i] = _relaxed(levels[i], after, end if last and i == len(levels) - 1 else None)
    found = []
    for g in starts:
        state, labels, own = (0, g), [], 0
        for taken in path:
            while True:
                arc = taken[state]
                if arc is None or not arc[0]:
                    break
                labels.append(arc[0])
                own += arc[1]
                state = arc[2]
                if arc[0] != "I":
                    break
        found.append((after.get((0, g), _FAR) if levels else end[g], "".join(labels), state[1], own))
    return found


@lru_cache(maxsize=1 << 14)
def _whole(symbols: str) -> tuple[int, str, int, int]:
    return shortest(symbols)[0]


def transfer(symbols: str) -> list[int]:
    """The least cost from each state of the grammar to each over a stretch that is not the last."""
    out = [[_FAR] * STATES for _ in range(STATES)]
    for to in range(STATES):
        end = tuple(0 if g == to else _FAR for g in range(STATES))
        for g, found in enumerate(shortest(symbols, end, False, tuple(range(STATES)))):
            out[g][to] = min(found[0], _FAR)
    return [x for row in out for x in row]


#: The cost of ending well from each state, inserts included.
_CLOSED = tuple(found[0] for found in shortest("", ACCEPTED, True, tuple(range(STATES))))


def symbol_of(role: Column, fault: Column) -> Column:
    first = F.substring(role, 1, 1)
    plain = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    return F.when(fault.isin("blank", "duplicate"), MUST_GO).when(fault == "truncated", F.upper(plain)).otherwise(plain)


def diagnosed(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, at, block, fault, symbol): turns in order (at), with the first fault of each: blank, duplicate, truncated or null.

    Order is turn (null first), role, then the text's hash, so equal turns stand together.
    A null role or text is one space; a null conversation id is one conversation.  blank: no
    character but white space; duplicate: role and text stand earlier in the conversation;
    truncated: the last character but white space is none of ``.!?``."""
    c = lambda name: F.col(f"`{name}`")
    role, text = (F.coalesce(c(x), F.lit(" ")) for x in (role_col, text_col))
    rows = turns.select(c(conv_col).alias("conv_id"), c(turn_col).alias("turn"), role.alias("role"), text.alias("text"), F.xxhash64(role, text).alias("ka"), F.xxhash64(F.lit(2), role, text).alias("kb"))
    own = F.when(~F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")), "blank").when(~F.regexp_like(F.substring(F.regexp_replace(text, r"[\x20\x09-\x0D]++\z", ""), -1, 1), F.lit(r"[.!?]")), "truncated")
    placed = dealt(rows.withColumn("fault", own), ["conv_id"], ["turn", "role", "ka", "kb"])
    # only what occurs more than once is looked at again, and of that only the first place moves
    again = placed.groupBy("conv_id", "ka", "kb").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = cut(again.select(F.col("conv_id").alias("c"), F.col("ka").alias("x"), F.col("kb").alias("y"), "first"), "again")
    seen = placed.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("ka") == F.col("x")) & (F.col("kb") == F.col("y")), "left")
    fault = F.when(F.col("fault").eqNullSafe("blank"), "blank").when(F.col("at") > F.col("first"), "duplicate").otherwise(F.col("fault"))
    out = seen.select("conv_id", "turn", "role", "text", "at", F.shiftright("at", BLOCK_BITS).alias("block"), fault.alias("fault"))
    done = cut(out.withColumn("symbol", symbol_of(F.col("role"), F.col("fault"))), "diagnosed")
    discard(placed, again)
    return done


_SCRIPT = "script string, entry int, cost long"


def _mapped(df: DataFrame, keep: list[str], give, shape: str) -> DataFrame:
    """keep's columns of df and those that give(rows of a batch as tuples of df's columns) returns, a tuple a row."""
    names = [x.split()[0] for x in shape.split(", ")]
    place = [df.columns.index(k) for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for b in batches:
            made = [give(row, state) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            new = list(zip(*made, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in place), *(pa.array(list(v), t) for v, t in zip(new, kinds, strict=True))], names=[*keep, *names])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    parsed = _parse_datatype_string(shape)
    kinds = [to_arrow_type(f.dataType) for f in parsed]
    schema = df.select(*keep).schema
    for f in parsed:
        schema = schema.add(f)
    return df.mapInArrow(run, schema)


def scripts(rows: DataFrame) -> DataFrame:
    """(conv_id, block, script, entry, cost, initials): the labels of each block of diagnosed turns, the state before it and its cost.

    script has K, R, D for each turn in order and I for each turn inserted before the next
    (in the last block also behind the last)."""
    ship(rows.sparkSession)
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise(".")
    told = F.array_sort(F.collect_list(F.struct("at", "symbol", initial.alias("initial"))))
    text = lambda f: F.array_join(F.transform("told", lambda x: x[f]), "")
    blocks = rows.groupBy("conv_id", "block").agg(told.alias("told")).select("conv_id", "block", text("symbol").alias("symbols"), text("initial").alias("initials"))
    n = blocks.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("n"), F.max("block").alias("end"))
    blocks = cut(blocks.join(n, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c"), "blocks")
    keep = ["conv_id", "block", "initials"]
    one = _mapped(blocks.where("n = 1").select(*keep, "symbols"), keep, _one, _SCRIPT)
    several = blocks.where("n > 1").select("conv_id", "block", "initials", "symbols", (F.col("block") == F.col("end")).alias("last"))
    moved = _mapped(several.repartition("conv_id", "block"), [*keep, "symbols", "last"], lambda r, _: (transfer(r[3]),), "moves array<bigint>")
    ahead = _mapped(moved.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block")), [*keep, "symbols", "last"], _to_go, "ahead array<bigint>")
    ways = _mapped(ahead.repartition("conv_id", "block"), keep, lambda r, _: (_ways(r[3], r[4], r[5]),), "ways array<struct<labels:string,to:int,cost:bigint>>")
    chosen = _mapped(ways.repartition("conv_id").sortWithinPartitions("conv_id", "block"), keep, _choice, _SCRIPT)
    return cut(one.unionByName(chosen), "scripts")


def _one(row: tuple, _: dict) -> tuple[str, int, int]:
    found = _whole(row[3]) if len(row[3]) <= 64 else shortest(row[3])[0]  # short ones recur
    return found[1], 0, found[3]


def _to_go(row: tuple, state: dict) -> tuple[list[int]]:
    """Costs to go behind a block; blocks come from the last to the first of a conversation."""
    last, moves = row[4], row[5]
    behind = list(_CLOSED) if last else state["next"]
    state["next"] = [min(_FAR, *(moves[g * STATES + to] + behind[to] for to in range(STATES))) for g in range(STATES)]
    return (list(ACCEPTED) if last else behind,)


def _ways(symbols: str, last: bool, ahead: list[int]) -> list[dict]:
    return [{"labels": labels, "to": to, "cost": own} for _, labels, to, own in shortest(symbols, tuple(ahead), last, tuple(range(STATES)))]


def _choice(row: tuple, state: dict) -> tuple[str, int, int]:
    """The way from the state that the block before has led to; blocks come from the first to the last of a conversation."""
    if state.get("conv", state) != row[0]:
        state["conv"], state["at"] = row[0], 0
    at = state["at"]
    way = row[3][at]
    state["at"] = way["to"]
    return way["labels"], at, way["cost"]


_REPAIRED = "place long, edit string, turn long, role string, text string, fault string"


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text, fault): diagnosed turns as their scripts leave them, in order of place, and what is inserted (turn null, text empty).

    Deleted turns come with edit D.  A block's script travels as a row before its turns, so
    texts are dealt once more and never leave Arrow."""
    ship(rows.sparkSession)
    cols = ["conv_id", "block", "at", "turn", "role", "text", "fault", "script", "entry"]
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    turns = rows.select("conv_id", "block", "at", F.col("turn").cast("long").alias("turn"), "role", "text", "fault", none("script", "string"), none("entry", "int"))
    heads = found.select("conv_id", "block", none("at", "long"), none("turn", "long"), none("role", "string"), none("text", "string"), none("fault", "string"), "script", "entry")
    # the kind is what tells a head from a turn: a block's head comes first
    both = turns.unionByName(heads).select(*cols).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at")
    kind = both.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        conv_type = to_arrow_type(kind)
        conv, script, i, g, at = None, "", 0, 0, 0
        for b in _then_none(batches):
            out: list[tuple] = []

            def inserts(place: int) -> None:
                nonlocal i, g
                k = 0
                while i < len(script) and script[i] == "I":
                    role = next(r for r in ROLES if (g, r) in GRAMMAR)
                    out.append((conv, None, place + k, "I", None, ROLES[role], None))
                    g, i, k = GRAMMAR[g, role], i + 1, k + 1

            if b is None:
                inserts(at * 8 + 3)
            else:
                lists = [b.column(x).to_pylist() for x in (0, 2, 3, 4, 6, 7, 8)]
                for n, (c, row_at, turn, role, fault, labels, entry) in enumerate(zip(*lists, strict=True)):
                    if row_at is None:
                        inserts(at * 8 + 3)
                        conv, script, i, g = c, labels, 0, entry
                        continue
                    at = row_at
                    inserts(at * 8)
                    edit, i = script[i], i + 1
                    if edit == "K":
                        g = GRAMMAR[g, role[0]]
                    elif edit == "R":
                        new = next(r for r in ROLES if (g, r) in GRAMMAR)
                        role, g = ROLES[new], GRAMMAR[g, new]
                    out.append((c, n, at * 8 + 2, edit, turn, role, fault))
            if out:
                c, n, place, edit, turn, role, fault = (list(x) for x in zip(*out, strict=True))
                text = pa.array([""] * len(out)) if b is None else b.column(5).take(pa.array(n, pa.int32())).fill_null("")
                yield pa.RecordBatch.from_arrays([pa.array(c, conv_type), pa.array(place, pa.int64()), pa.array(edit), pa.array(turn, pa.int64()), pa.array(role, pa.string()), text, pa.array(fault, pa.string())], names=["conv_id", "place", "edit", "turn", "role", "text", "fault"])

    schema = both.select("conv_id").schema
    from pyspark.sql.types import _parse_datatype_string

    for f in _parse_datatype_string(_REPAIRED):
        schema = schema.add(f)
    return both.mapInArrow(run, schema)


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def summary(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for each conversation that has turns.

    gaps: turn numbers between the least and the largest that no turn has; illegal: adjacent
    turns whose role initials are none of su, ua, au; audit: the labels of the whole
    conversation, one value of a character for each turn and insert."""
    count = lambda f: F.count_if(F.col("fault") == f).alias(f)
    gap = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    told = rows.groupBy("conv_id").agg(gap.alias("gaps"), count("blank"), count("duplicate"), count("truncated"))
    parts = found.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "script", "initials"))).alias("p"), F.sum("cost").alias("cost"))
    text = lambda f: F.array_join(F.transform("p", lambda x: x[f]), "")
    initials = text("initials")
    illegal = (F.greatest(F.length(initials) - 1, F.lit(0)) - F.regexp_count(initials, F.lit("(?=su|ua|au)"))).cast("long")
    paths = parts.select(F.col("conv_id").alias("c"), illegal.alias("illegal"), "cost", text("script").alias("audit"))
    return told.join(paths, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
