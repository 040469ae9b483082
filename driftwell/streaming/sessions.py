"""The session fold as a stream, in event time: the same step, the same order and the same expiry as in batch.

Events wait until the watermark has passed them and are then taken in order of ts and
event_id, so micro-batches may come in any order within the watermark's delay.  An event
older than the watermark when its micro-batch began would have to be taken out of order:
it is told apart (action ``late``) and changes nothing.  State goes by an event-time timer
when a session was silent for longer than its time to live.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from driftwell.operators.sessions import OUT, TTL_S, State, micros, prepared, step



def _shape(**fields: str) -> T.StructType:
    """A schema without a session, which the worker that lays out the state has not."""
    out = T.StructType()
    for name, kind in fields.items():
        out = out.add(name, kind)
    return out


_EVENT = _shape(us="long", event_id="long", kind="string", verdict="string", instance="string", head="string", facts_ok="boolean", continuation="boolean")
_FIELDS = _EVENT.names
#: Beside the fold's columns: the event's time, verdict, head and instance, for what is written of it.
STREAM_OUT = OUT + ", us long, new string, new_head string, instance string"
#: What is said of an event that came after the watermark had passed it.
LATE = "late"


class Sessions(StatefulProcessor):
    """State of a session: what the fold knows (known), the instances it has consumed (ids), and the events that wait (waiting)."""

    def __init__(self, ttl_s: float | None = TTL_S):
        self.ttl_us = None if ttl_s is None else round(ttl_s * 1_000_000)

    def init(self, handle) -> None:
        self.handle = handle
        shape = _shape(marker="boolean", verdict="string", head="string", blocks="long", last="long")
        self.known = handle.getValueState("known", shape)
        self.ids = handle.getMapState("ids", _shape(id="string"), _shape(seen="boolean"))
        self.waiting = handle.getListState("waiting", _EVENT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        new = []
        for r in rows:
            if r["us"] // 1000 < mark:
                s = self.known.get() if self.known.exists() else (False, None, None, 0, 0)
                yield Row(event_id=r["event_id"], session=key[0], action=LATE, verdict=s[1], head=s[2], blocks=s[3], us=r["us"], new=r["verdict"], new_head=r["head"], instance=r["instance"])
            else:
                new.append(tuple(r[f] for f in _FIELDS))
        if new:
            self.waiting.appendList(new)
            # the watermark has passed an event when it is beyond the event's millisecond
            self.handle.registerTimer(min(x[0] for x in new) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        every = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted(x for x in every if x[0] // 1000 < mark)
        left = [x for x in every if x[0] // 1000 >= mark]
        at = self.known.get() if self.known.exists() else None
        s, last = (State(at[0], at[1], at[2], set(), at[3]), at[4]) if at else (State(), None)
        for us, event_id, kind, verdict, instance, head, ok, again in due:
            if self._silent(last, us):
                s = State()
                self.ids.clear()
            last = us
            if instance and self.ids.containsKey((instance,)):
                s.ids = {instance}
            before = set(s.ids)
            done = step(s, kind, verdict, instance, head, ok, again)
            for new in s.ids - before:
                self.ids.updateValue((new,), (True,))
            s.ids = set()
            yield Row(event_id=event_id, session=key[0], action=done, verdict=s.verdict, head=s.head, blocks=s.blocks, us=us, new=verdict, new_head=head, instance=instance)
        if due:
            if left:
                self.waiting.put(left)
                self.handle.registerTimer(min(x[0] for x in left) // 1000 + 1)
            else:
                self.waiting.clear()
            self.known.update((s.marker, s.verdict, s.head, s.blocks, last))
            if self.ttl_us is not None:
                self.handle.registerTimer((last + self.ttl_us) // 1000 + 2)
        elif at and not every and self._silent(last, mark * 1000):
            self.known.clear()
            self.ids.clear()

    def _silent(self, last: int | None, us: int) -> bool:
        return self.ttl_us is not None and last is not None and us - last > self.ttl_us

    def close(self) -> None:
        return


def stream_fold(events: DataFrame, ttl_s: float | None = TTL_S, delay: str = "1 hour") -> DataFrame:
    """The streaming twin of operators.sessions.fold; needs the RocksDB state store.

    delay: how much older than the newest event an event may be and still be taken in its
    place.  A row a event: the fold's, when the watermark has passed the event, or at once
    with action late.  Events without ts or event_id have no place and are left out."""
    marked = events.withColumn("_mark", F.col("ts").cast("timestamp")).withWatermark("_mark", delay)
    # the number below carries no watermark of its own, so that late events reach the operator, which names them
    keyed = prepared(marked).withColumn("us", micros(F.col("ts"))).where("us is not null and event_id is not null").select("session", *_FIELDS)
    return keyed.groupBy("session").transformWithState(Sessions(ttl_s), T._parse_datatype_string(STREAM_OUT), "Append", "EventTime")
