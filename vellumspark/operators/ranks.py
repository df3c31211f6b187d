"""Values at given ranks of a whole table, by histograms refined around each rank.

A pass counts values in 4096 ranges of each interval that holds a wanted rank, by
partial aggregation, so what is shuffled and gathered is a bounded number of
counts. The range that holds the rank becomes the next interval, from its least to
its greatest value; two or three passes leave an interval that few distinct
values share. No task ever holds or sorts all values.

Defined results: null and NaN are left out; ranks count from 0; a table without
values has none at any rank.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges that an interval is cut into; values in an interval that are gathered as counts of distinct values.
BINS, FEW = 4096, 20_000


def numbers(rows: DataFrame, value: str) -> DataFrame:
    """v: the values that count."""
    kept = rows.select(F.col(value).alias("v")).filter("v is not null")
    return kept.filter(~F.isnan("v")) if rows.schema[value].dataType.simpleString() in ("double", "float") else kept


def values_at(rows: DataFrame, value: str, ranks: list[int]) -> list:
    """The values of the ranks in rising order."""
    kept = numbers(rows, value)
    ends = kept.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).first()
    #: rank to (least, greatest, values below, values inside) of the interval that holds it
    inside = {r: (ends["low"], ends["high"], 0, ends["n"]) for r in ranks if 0 <= r < ends["n"]}
    while True:
        todo = sorted({i for i in inside.values() if i[0] != i[1]})
        if not todo:
            return [inside[r][0] if r in inside else None for r in ranks]
        found = defaultdict(list)
        wide = [i for i in todo if i[3] > FEW and float(i[0]) < float(i[1])]
        for r in _ranges(kept, wide):
            found[wide[r["i"]]].append((r["low"], r["high"], r["n"]))
        for i in todo:
            if i not in found:
                counted = kept.filter(F.col("v").between(i[0], i[1])).groupBy("v").count().collect()  # FEW of them at most
                found[i] = [(r["v"], r["v"], r["count"]) for r in counted]
        for rank, i in inside.items():
            below = i[2]
            for low, high, n in sorted(found.get(i, ())):
                if rank < below + n:
                    inside[rank] = (low, high, below, n)
                    break
                below += n


def _ranges(kept: DataFrame, intervals: list[tuple]) -> list:
    """i, low, high, n of each range of each interval that holds values."""
    if not intervals:
        return []
    place = None
    for k, (low, high, _, _) in enumerate(intervals):
        low, high = float(low), float(high)
        scale = 1.0 if math.isfinite(high - low) else 0.5
        x = (F.col("v").cast("double") * scale - low * scale) / (high * scale - low * scale)
        bin_ = F.least(F.floor(x * BINS), F.lit(BINS - 1)).cast("int")
        inside = F.col("v").between(intervals[k][0], intervals[k][1])
        one = F.struct(F.lit(k).alias("i"), bin_.alias("bin"))
        place = F.when(inside, one) if place is None else place.when(inside, one)
    placed = kept.select("v", place.alias("p")).filter("p is not null")
    return placed.groupBy("p").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).select("p.i", "low", "high", "n").collect()
