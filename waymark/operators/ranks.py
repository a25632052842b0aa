"""Values at exact ranks of groups of any size, without bringing a group's values together.

Quantile sketches, which merge before they are shuffled, give for each rank two values that it lies
between. Values below are only counted, and those between, a few thousandths of
the group, are counted by value and run through in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A sketch is right to one part in so many; groups of no more values are between as a whole.
ACCURACY = 2000


@dataclass(frozen=True)
class Rank:
    """A place in a group's sorted values: near ``share`` of them, exactly where ``index`` of their number says, from 0."""

    share: float
    kind: str

    def index(self, n: Column) -> Column:
        if self.kind == "nearest":
            return F.bround(F.lit(self.share) * (n - 1)).cast("long")
        return F.floor(n / 2).cast("long")


def nearest(q: float) -> Rank:
    """Position q * (n - 1), rounded half to even."""
    return Rank(q, "nearest")


UPPER_MEDIAN = Rank(0.5, "upper")


def at_ranks(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, Rank]) -> DataFrame:
    """``keys`` and a column for each of ``wanted``: the value of ``rows`` at that rank of the keys' values; null values don't count, and groups without any have nulls. Null keys are a group."""
    v, names = F.col(value), list(wanted)
    around = [x for r in wanted.values() for x in (max(0.0, r.share - 3 / ACCURACY), min(1.0, r.share + 3 / ACCURACY))]
    groups = rows.groupBy(*keys).agg(F.count(v).alias("n_"), F.min(v).alias("min_"), F.max(v).alias("max_"), F.percentile_approx(v, around, ACCURACY).alias("q_"))
    whole = F.col("n_") <= ACCURACY
    # At the ends the sketch may be off, but not beyond the least and greatest value.
    low = lambda i, r: F.when(whole | F.lit(r.share < 4 / ACCURACY), F.col("min_")).otherwise(F.get("q_", F.lit(2 * i)))
    high = lambda i, r: F.when(whole | F.lit(r.share > 1 - 4 / ACCURACY), F.col("max_")).otherwise(F.get("q_", F.lit(2 * i + 1)))
    spans = F.array(*[F.struct(F.lit(i).alias("i_"), low(i, r).alias("low_"), high(i, r).alias("high_"), r.index(F.col("n_")).alias("index_")) for i, r in enumerate(wanted.values())])
    spans = groups.where("n_ > 0").select(*[F.col(k).alias(f"{k}_") for k in keys], F.inline(spans))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    met = rows.where(v.isNotNull()).select(*keys, v.alias("v_")).join(spans, same).where("v_ <= high_").select(*keys, "i_", "index_", F.when(F.col("v_") >= F.col("low_"), F.col("v_")).alias("v_"))
    counts = met.groupBy(*keys, "i_", "index_", "v_").agg(F.count("*").alias("c_"))  # null: all that lies below
    upto = F.sum("c_").over(Window.partitionBy(*keys, "i_").orderBy(F.col("v_").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("upto_", upto).where("upto_ > index_ and v_ is not null").groupBy(*keys, "i_").agg(F.min("v_").alias("v_"))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("i_") == i, F.col("v_"))).alias(name) for i, name in enumerate(names)])
    wide = wide.select(*[F.col(k).alias(f"{k}_") for k in keys], *names)
    return groups.select(*keys).join(wide, same, "left").select(*keys, *names)
