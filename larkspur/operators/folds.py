"""Ordered folds as streams: rows of a key, in order, pass through a small state; no group is ever held."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a result that are sent on at once.
AT_ONCE = 10_000


class Fold(Protocol):
    """What runs over the rows of one key: ``add`` takes a row's columns, ``end`` comes after the last; both give rows."""

    def add(self, *row) -> Iterable[tuple]: ...

    def end(self) -> Iterable[tuple]: ...


def streamed(rows: DataFrame, key: list[str], order: list, columns: list[str], make: Callable[..., Fold], schema: str) -> DataFrame:
    """The rows that a fold gives for each key: make(*key) starts one, which gets ``columns`` row by row in ``order``.

    Partitions hold whole keys and are sorted by Spark (which spills); one pass in Arrow batches carries the state of the
    key at hand over the batches' ends. So millions of small keys cost no call each, and a key of any size costs no memory but
    its fold's own. A key's rows run in one task, as their order matters; folds that can start amid a key should be given
    finer keys and be put together by a second fold (see ``invest.average_cost``). Null keys are keys."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, at, out = None, None, []

        def full() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)
            out.clear()
            return made

        for batch in batches:
            values = [c.to_pylist() for c in batch.columns]
            for k, row in zip(zip(*values[: len(key)]), zip(*values[len(key) :])):
                if fold is None or k != at:
                    if fold is not None:
                        out.extend(fold.end())
                    at, fold = k, make(*k)
                out.extend(fold.add(*row))
                if len(out) >= AT_ONCE:
                    yield full()
        if fold is not None:
            out.extend(fold.end())
        if out:
            yield full()

    # by a hash of its own: Spark drops a repartition that a join before it already gave, and may then turn that join into a
    # broadcast whose rows are read where they lie, so that keys fall apart over tasks
    return rows.repartition(F.xxhash64(*key)).sortWithinPartitions(*key, *order).select(*key, *columns).mapInArrow(each, schema)
