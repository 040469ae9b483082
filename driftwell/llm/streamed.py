"""SHA-256 of ordered groups of any size.

The values of a group are joined to pieces where they lie, by ranges of key and order, so a
group of any size is joined by many tasks; its pieces then stream in order through one hash,
which is all that has to be done one after the other, in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Bytes of a piece before it is sent on.
PIECE = 1 << 20


def digests(df: DataFrame, keys: list[str], order: str, value: str | None = None, separator: str = ",") -> DataFrame:
    """keys and sha256 (lowercase hex): that of each group's values in order, as text, joined by separator.

    Values are those of `value` (of the order, if it is not given); null values are left
    out, a null key is a key.  Equal places are taken in any order."""
    value = value or order
    rows = df.select(*keys, order, df[value].cast("string").alias("_value")).where("_value is not null")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    types = [f.dataType for f in rows.select(*keys).schema]
    gap = separator.encode()
    wide = len(keys)

    def arrow(columns: list[list], names: list[str], last: list[pa.DataType]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [*(to_arrow_type(t) for t in types), *last]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId() << 33, 0
        now, held, size, out, out_size = None, [], 0, [], 0
        names = [*keys, "_no", "_piece"]
        send = lambda: arrow([list(c) for c in zip(*out, strict=True)], names, [pa.int64(), pa.binary()])
        for b in batches:
            for *key, text in zip(*(b.column(i).to_pylist() for i in (*range(wide), wide + 1)), strict=True):
                if held and (key != now or size > PIECE):
                    out.append((*now, part + no, gap.join(held)))
                    no, out_size, held, size = no + 1, out_size + size, [], 0
                    if out_size > 4 * PIECE or len(out) > 10_000:
                        yield send()
                        out, out_size = [], 0
                now = key
                held.append(text.encode())
                size += len(held[-1])
        if held:
            out.append((*now, part + no, gap.join(held)))
        if out:
            yield send()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, out = None, None, []
        names = [*keys, "sha256"]
        send = lambda: arrow([list(c) for c in zip(*out, strict=True)], names, [pa.string()])
        for b in batches:
            for *key, piece in zip(*(b.column(i).to_pylist() for i in (*range(wide), wide + 1)), strict=True):
                if h is None or key != now:
                    if h is not None:
                        out.append((*now, h.hexdigest()))
                        if len(out) > 10_000:
                            yield send()
                            out = []
                    now, h = key, hashlib.sha256(piece)
                else:
                    h.update(gap)
                    h.update(piece)
        if h is not None:
            out.append((*now, h.hexdigest()))
        if out:
            yield send()

    joined = rows.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order).mapInArrow(pieces, f"{shape}, _no long, _piece binary")
    return joined.repartition(*keys).sortWithinPartitions(*keys, "_no").mapInArrow(hashes, f"{shape}, sha256 string")
