"""Order statistics over groups of any size: running sums, positions and exact quantiles, none of them in one task a group.

A window over a key puts all rows of the key into one task. Here Spark deals rows by ranges of (key, order), so that a key
with a third of all rows lies in a third of the ranges; sums run within a range, and what the ranges before it hold is
added. Only keys that go on from one range into the next need that, and each cut between two ranges splits one key at most, so
the table of what lies before has no more rows than there are ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored

#: Rows of a key that one task may sort.
MOST = 1_000_000
#: Values that the driver sorts in the last step of a quantile.
FEW = 20_000


def running_sum(df: DataFrame, keys: list[str], order: list[str], amount: str, name: str) -> DataFrame:
    """Adds name: the sum of amount over the rows of the same keys up to and with this one, in rising order.

    order must tell rows of a key apart, or rows equal in it come in any order. Null keys are a key; the sum of nulls is
    taken as zero. df is read once.
    """
    parts = stored(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = parts.withColumn("_own", F.coalesce(F.sum(amount).over(own), F.lit(0)))
    totals = parts.groupBy(*keys, "_range").agg(F.coalesce(F.sum(amount), F.lit(0)).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), F.sum("_sum").over(before).alias("_before")).where("_before IS NOT NULL")
    met = local.join(F.broadcast(ahead), [F.col("_range") == F.col("_r"), *(F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys))], "left")
    return met.select(*df.columns, (F.col("_own") + F.coalesce("_before", F.lit(0))).alias(name))


def positions(df: DataFrame, keys: list[str], order: list[str], name: str = "position", most: int = MOST) -> DataFrame:
    """Adds name: how many rows of the same keys come before this one. If no key has more than most rows, a plain window
    per key does it."""
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if largest <= most:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    return running_sum(df.withColumn("_one", F.lit(1)), keys, order, "_one", name).withColumn(name, F.col(name) - 1).drop("_one")


def _wanted(n: int, fraction: float) -> tuple[int, int, float]:
    """The two neighbouring ranks from 0 between which a quantile lies, and how far it is from the first."""
    at = fraction * (n - 1)
    low = min(int(at), n - 1)
    return low, min(low + 1, n - 1), at - low


def exact_quantiles(df: DataFrame, value: Column, fractions: list[float], few: int = FEW) -> tuple[int, list[float | None]]:
    """(rows with a value, the quantiles at these fractions, between neighbours in proportion), as percentile() gives them.

    Each round a sketch names an interval for each quantile and an exact count says where the interval stands, until few
    values are left in it; only these come to the driver. A sketch of n rows errs by n / 10,000 ranks at most, so three
    rounds do for 10 ** 12 rows; a sketch that errs more costs a round, never the result.
    """
    rows = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    first = rows.agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    n = first["n"]
    if not n:
        return 0, [None] * len(fractions)
    ranks = [_wanted(n, f) for f in fractions]
    spans = [(first["low"], first["high"], 0, n) for _ in fractions]  # low, high, rows under low, rows within
    while any(s[3] > few and s[0] < s[1] for s in spans):
        inside = [(F.col("v") >= F.lit(s[0])) & (F.col("v") <= F.lit(s[1])) for s in spans]
        shares = [[min(1.0, max(0.0, (r + d - s[2]) / max(1, s[3] - 1))) for r, d in ((ranks[i][0], -s[3] / 4000), (ranks[i][1], s[3] / 4000))] for i, s in enumerate(spans)]
        sketched = rows.agg(*(F.percentile_approx(F.when(x, F.col("v")), F.array(*map(F.lit, shares[i])), 10_000).alias(f"s{i}") for i, x in enumerate(inside))).first()
        bounds = [tuple(sketched[f"s{i}"]) for i in range(len(spans))]
        counted = rows.agg(
            *(F.count_if(F.col("v") < F.lit(b[0])).alias(f"u{i}") for i, b in enumerate(bounds)), *(F.count_if((F.col("v") >= F.lit(b[0])) & (F.col("v") <= F.lit(b[1]))).alias(f"w{i}") for i, b in enumerate(bounds)),
        ).first()
        new = []
        for i, (s, b) in enumerate(zip(spans, bounds, strict=True)):
            under, within = counted[f"u{i}"], counted[f"w{i}"]
            if under > ranks[i][0]:  # the sketch missed: what it names lies above
                new.append((s[0], b[0], s[2], under - s[2] + 1))
            elif under + within <= ranks[i][1]:
                new.append((b[0], s[1], under, s[2] + s[3] - under))
            else:
                new.append((b[0], b[1], under, within))
        if new == spans:
            few = max(few, *(s[3] for s in spans))  # nothing more to narrow: all its rows are close to one value
        spans = new
    any_of = F.lit(False)
    for s in spans:
        any_of = any_of | ((F.col("v") >= F.lit(s[0])) & (F.col("v") <= F.lit(s[1])))
    found = sorted((r["v"], r["c"]) for r in rows.where(any_of).groupBy("v").agg(F.count(F.lit(1)).alias("c")).collect())

    def at(rank: int, span: tuple) -> float:
        seen = span[2]
        for v, c in found:
            if v >= span[0]:
                seen += c
                if rank < seen:
                    return v
        raise AssertionError("a rank lies outside its interval")

    return n, [low + (high - low) * part if (low := at(a, s)) != (high := at(b, s)) else low for (a, b, part), s in zip(ranks, spans, strict=True)]
