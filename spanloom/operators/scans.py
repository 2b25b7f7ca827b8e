"""Scans along the rows of a key in two levels, so that one key's rows may be in many tasks.

Rows are dealt to ranges of (key, slot); slots are in the order of the scan, as spans of time are. Within a range a window
gives each row its state so far; a range's state at its end is one row; these are scanned along the key, and what came before
a range is joined back to its rows. A key's second level has a row for each slot, however many rows a slot has. Such a join
reads the rows' plan twice, so scans that don't need each other's results are done together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a slot in the unit of the rows' times.
WIDTH = 3600.0


def slot_of(time: Column, width: float = WIDTH) -> Column:
    """The slot of a time; slots ascend with times, and rows without one come last."""
    return F.coalesce(F.floor(time / F.lit(width)).cast("long"), F.lit(1 << 62))


class Scan:
    """Rows with ``keys`` and a column ``slot``, neither null, scanned in ``order`` within slots, slots ascending.

    Windows and joins share the partitioning by keys and slot, so rows are shuffled once, whatever scans follow each other.
    """

    def __init__(self, keys: Sequence[str], slot: str, order: Sequence[Column | str]):
        self.keys, self.slot, self.order = list(keys), slot, list(order)

    def _near(self, *more: str):
        return Window.partitionBy(*self.keys, self.slot, *more).orderBy(*self.order)

    def _along(self, *more: str):
        return Window.partitionBy(*self.keys, *more).orderBy(self.slot).rowsBetween(Window.unboundedPreceding, -1)

    def _joined(self, rows: DataFrame, ends: DataFrame, *more: str) -> DataFrame:
        """``rows`` with the columns that ``ends`` has for their range."""
        return rows.join(ends, [*self.keys, self.slot, *more], "left")

    def together(self, rows: DataFrame, sums: dict[str, Column], previous: dict[str, str] | None = None) -> DataFrame:
        """``rows`` with a column for each of ``sums``, the sum of its values up to and including each row, and for each of
        ``previous``, the value that another column, never null, has in the row before; null of a key's first row.

        All of them share one table of ranges, and one join.
        """
        previous = previous or {}
        near = rows.withColumns({f"__v{k}": v.cast("long") for k, v in enumerate(sums.values())})
        upto = self._near().rowsBetween(Window.unboundedPreceding, 0)
        near = near.withColumns({f"__s{k}": F.sum(f"__v{k}").over(upto) for k in range(len(sums))} | {f"__p{k}": F.lag(c).over(self._near()) for k, c in enumerate(previous.values())} | {"__rank": F.row_number().over(self._near())})
        whole = [F.sum(f"__v{k}").alias(f"__t{k}") for k in range(len(sums))] + [F.max_by(c, "__rank").alias(f"__l{k}") for k, c in enumerate(previous.values())]
        ends = near.groupBy(*self.keys, self.slot).agg(*whole)
        ends = ends.select(*self.keys, self.slot, *(F.coalesce(F.sum(f"__t{k}").over(self._along()), F.lit(0)).alias(f"__b{k}") for k in range(len(sums))), *(F.last(f"__l{k}").over(self._along()).alias(f"__q{k}") for k in range(len(previous))))
        out = self._joined(near, ends)
        made = {name: F.col(f"__s{k}") + F.col(f"__b{k}") for k, name in enumerate(sums)} | {name: F.coalesce(f"__p{k}", f"__q{k}") for k, name in enumerate(previous)}
        used = [f"__{x}{k}" for k in range(len(sums)) for x in "vsb"] + [f"__{x}{k}" for k in range(len(previous)) for x in "pq"]
        return out.withColumns(made).drop("__rank", *used)

    def summed(self, rows: DataFrame, value: Column, name: str) -> DataFrame:
        """``rows`` with ``name``: the sum of ``value`` up to and including each row."""
        return self.together(rows, {name: value})

    def highest_before(self, rows: DataFrame, value: str, name: str, *within: str) -> DataFrame:
        """``rows`` with ``name``: the highest ``value`` of the rows before of the same key and the same ``within``, if given."""
        near = rows.withColumn("__near", F.max(value).over(self._near(*within).rowsBetween(Window.unboundedPreceding, -1)))
        ends = rows.groupBy(*self.keys, self.slot, *within).agg(F.max(value).alias("__max"))
        ends = ends.withColumn("__before", F.max("__max").over(self._along(*within))).drop("__max")
        return self._joined(near, ends, *within).withColumn(name, F.greatest("__near", "__before")).drop("__near", "__before")
