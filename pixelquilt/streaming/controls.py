"""A stream of control changes: the value that was set last, bursts that have settled, results that are not out of date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def latest(changes: DataFrame, key: str = "label", value: str = "value", order: str = "seq") -> DataFrame:
    """(key, value, order) with the highest order for each key; batch or stream (complete or update mode).

    A stale change that arrives late doesn't overwrite a newer one.
    """
    return changes.groupBy(key).agg(F.max(F.struct(order, value)).alias("x")).select(key, F.col(f"x.{value}").alias(value), F.col(f"x.{order}").alias(order))


def debounce(changes: DataFrame, key: str = "label", value: str = "value", order: str = "seq", time: str = "ts", gap: str = "100 milliseconds") -> DataFrame:
    """(key, began, fired, order, value, changes): a row for each burst of changes of a key, once nothing
    has changed for more than ``gap``; its value is that of the highest order, of equal ones the largest.

    Batch, or stream in append mode with a watermark on ``time``, which closes bursts as it passes
    them; changes later than the watermark are dropped by it.  Changes without a key or a time are
    left out.  Spark keeps a burst's running result as state, never its changes.
    """
    burst = F.session_window(F.col(time), gap)
    found = changes.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(key, burst.alias("burst")).agg(F.max(F.struct(order, value)).alias("x"), F.count(F.lit(1)).alias("changes"))
    return found.select(key, F.col("burst.start").alias("began"), F.col("burst.end").alias("fired"), F.col(f"x.{order}").alias(order), F.col(f"x.{value}").alias(value), "changes")


class _Newest(StatefulProcessor):
    """Passes a key's results on whose order exceeds all before; keeps that one number for each key."""

    def __init__(self, order: str, arrives: str):
        self.order, self.arrives = order, arrives

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shown = handle.getValueState("shown", "shown long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows), ignore_index=True).sort_values([self.arrives, self.order], kind="stable", ignore_index=True)
        shown = self.shown.get()[0] if self.shown.exists() else None
        before = got[self.order].cummax().shift()
        if shown is not None:
            before = before.fillna(shown).clip(lower=shown)
        kept = got[before.isna() | (got[self.order] > before)]
        if len(kept):
            self.shown.update((int(kept[self.order].iloc[-1]),))
            yield kept

    def close(self) -> None:
        pass


def drop_stale(results: DataFrame, key: str = "label", order: str = "seq", arrives: str = "ts") -> DataFrame:
    """The results that are newer than all of their key that arrived before them.

    ``order`` says which change a result belongs to, ``arrives`` when it came; of those that arrive
    together the lower orders come first.  Results without a key or an order are left out.  In a
    batch this is a window over each key; in a stream (append or update mode, RocksDB state
    store) the highest order shown is kept for each key, within a micro-batch ``arrives`` sorts.
    """
    some = results.where(F.col(key).isNotNull() & F.col(order).isNotNull())
    if not results.isStreaming:
        before = Window.partitionBy(key).orderBy(arrives, order).rowsBetween(Window.unboundedPreceding, -1)
        return some.withColumn("_shown", F.max(order).over(before)).where(F.col("_shown").isNull() | (F.col(order) > F.col("_shown"))).drop("_shown")
    schema = StructType(list(some.schema.fields))
    return some.groupBy(key).transformWithStateInPandas(_Newest(order, arrives), outputStructType=schema, outputMode="Append", timeMode="None")
