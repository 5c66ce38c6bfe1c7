"""Profiling and audit of whole tables, one aggregation each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import days_between, round2
from . import vocab
from .gates import classify_use
from .ranking import exact_quantiles


#: A word's edge by ASCII letters, digits and underscores alone, whatever the Java version.
WORD_EDGE = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def column_coverage(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Per column: populated rows, their share in percent and distinct values.

    Each row becomes a value for each column, and (column, value) is counted before the shuffle and after it, so a hot
    value is a count and no column is one task. approximate reads the distinct values from sketches instead.
    """
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    if approximate:
        one = distinct_from_sketches(coverage_sketches(df, columns)).select("column_name", "populated", "n_distinct")
    else:
        each = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns))
        values = df.select(F.inline(each)).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
        one = values.groupBy("column_name").agg(F.coalesce(F.sum(F.when(F.col("value") != "", F.col("n"))), F.lit(0)).alias("populated"), F.count("value").alias("n_distinct"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    out = every.join(one, "column_name", "left").crossJoin(total)
    return out.select("column_name", F.coalesce("populated", F.lit(0)).alias("populated"), round2(100.0 * F.coalesce("populated", F.lit(0)) / F.nullif("_n", F.lit(0))).alias("populated_pct"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


#: Log2 of the registers of a sketch: 1.04 / sqrt(2 ** 14) = 0.8 percent is one standard error of its count.
SKETCH_BITS = 14


def coverage_sketches(df: DataFrame, columns: list[str], drop: str | Column | None = None) -> DataFrame:
    """A table of sketches: per drop and column the rows that have a value and a mergeable sketch of the values. One pass
    over the rows, a few kilobytes a column: kept with each drop, it answers for any union of drops without their rows."""
    by = F.lit(None).cast("string") if drop is None else drop if isinstance(drop, Column) else F.col(drop)
    text = {c: F.col(c).cast("string") for c in columns}
    one = df.groupBy(by.cast("string").alias("drop")).agg(*(F.count(F.nullif(t, F.lit(""))).alias(f"p_{c}") for c, t in text.items()), *(F.hll_sketch_agg(t, F.lit(SKETCH_BITS)).alias(f"s_{c}") for c, t in text.items()))
    return one.select("drop", F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"p_{c}").alias("populated"), F.col(f"s_{c}").alias("sketch")) for c in columns))))


def distinct_from_sketches(sketches: DataFrame) -> DataFrame:
    """column_name, populated and n_distinct (an estimate) over all drops of a table of sketches."""
    return sketches.groupBy("column_name").agg(F.sum("populated").alias("populated"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows and share in percent per value, null included."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).crossJoin(total).select("value", "n", round2(100.0 * F.col("n") / F.col("_n")).alias("share_pct"))


def numeric_profile(df: DataFrame, column: str, floor: float) -> DataFrame:
    """Rows, p50, p90, p99, max and the share at or above the floor in percent. Quantiles are exact and selected in rounds
    (see ranking.exact_quantiles): no task holds the distinct values."""
    _, q = exact_quantiles(df, F.col(column), [0.5, 0.9, 0.99])
    one = df.agg(F.count(column).alias("n"), F.max(column).alias("max"), F.count_if(F.col(column) >= floor).alias("_a"))
    return one.select("n", *(F.lit(v).cast("double").alias(p) for v, p in zip(q, ("p50", "p90", "p99"), strict=True)), "max", round2(100.0 * F.col("_a") / F.nullif("n", F.lit(0))).alias("at_floor_pct"))


def duration_profile(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with both times, p10, p50 and p90 of the days between, and how many are negative."""
    days = days_between(F.col(end), F.col(start))
    _, q = exact_quantiles(df, days, [0.1, 0.5, 0.9])
    one = df.agg(F.count(days).alias("n"), F.count_if(days < 0).alias("n_negative"))
    return one.select("n", *(F.lit(v).cast("double").alias(p) for v, p in zip(q, ("p10", "p50", "p90"), strict=True)), "n_negative")


def cost_conflicts(df: DataFrame, revised: str, estimated: str) -> DataFrame:
    """How often either cost wins, they tie, and a zero stands next to a positive one."""
    r, e = F.col(revised), F.col(estimated)
    return df.agg(F.count_if(r > e).alias("revised_higher"), F.count_if(e > r).alias("estimated_higher"), F.count_if(r == e).alias("equal"), F.count_if((r == 0) & (e > 0)).alias("revised_zero_estimated_positive"), F.count_if(r.isNull() | e.isNull()).alias("one_missing"))


def use_conversions(df: DataFrame, existing: str, proposed: str) -> DataFrame:
    """Rows per class of existing and of proposed use."""
    nothing = F.lit(None).cast("string")
    return df.groupBy(classify_use(F.col(existing), nothing).alias("from_class"), classify_use(F.col(proposed), nothing).alias("to_class")).agg(F.count(F.lit(1)).alias("n"))


def role_coverage(contacts: DataFrame) -> DataFrame:
    """Per role: rows, and the share with a license and with a firm in percent."""
    return contacts.groupBy("role").agg(F.count(F.lit(1)).alias("n"), round2(100.0 * F.count("license") / F.count(F.lit(1))).alias("license_pct"), round2(100.0 * F.count("firm_name") / F.count(F.lit(1))).alias("firm_pct"))


def license_shapes(contacts: DataFrame, column: str) -> DataFrame:
    """Rows and first letter per shape, where 9 stands for digits and A for letters."""
    shape = F.regexp_replace(F.regexp_replace(F.upper(column), "[A-Z]", "A"), "[0-9]", "9")
    prefix = F.regexp_extract(F.upper(column), "^[A-Z]+", 0)
    return contacts.where(F.col(column).isNotNull()).groupBy(shape.alias("shape"), prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def date_disagreement(df: DataFrame, key: str, dates: list[str]) -> DataFrame:
    """Per date column: rows that have it and a dated key (yyyyMMdd first), and those where the day differs."""
    day = F.try_to_date(F.left(F.col(key), F.lit(8)), "yyyyMMdd") if hasattr(F, "try_to_date") else F.to_date(F.left(F.col(key), F.lit(8)), "yyyyMMdd")
    one = df.withColumn("_day", day).agg(*(F.count_if(F.col("_day").isNotNull() & F.col(d).isNotNull()).alias(f"n_{d}") for d in dates), *(F.count_if(F.col("_day") != F.to_date(d)).alias(f"x_{d}") for d in dates))
    return one.select(F.inline(F.array(*(F.struct(F.lit(d).alias("column_name"), F.col(f"n_{d}").alias("n_compared"), F.col(f"x_{d}").alias("n_different")) for d in dates))))


def shortlist_profile(survivors: DataFrame, contractors: DataFrame, firms: DataFrame, keyword: Column) -> DataFrame:
    """Of each profile's survivors: how many name a contractor, none, a firm of the trade, and the trade's keyword."""
    rows = survivors.join(contractors.select("permit_number", "gc_firm"), "permit_number", "left").join(firms, "permit_number", "left")
    return rows.groupBy("profile_id").agg(F.count(F.lit(1)).alias("survivors"), F.count("gc_firm").alias("with_contractor"), F.count_if(F.col("gc_firm").isNull()).alias("without_contractor"), F.count_if(F.coalesce("trade_firm_named", F.lit(False))).alias("with_trade_firm"), F.count_if(keyword).alias("with_keyword"))


def copy_policy_audit(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per row and rule (banned-language, em-dash) with a violation: the first match, how many, the first index from 0."""
    def rule(name: str, pattern: str) -> DataFrame:
        hits = F.regexp_extract_all(text, F.lit(pattern), 0)
        at = F.char_length(F.split(F.col(text), pattern, 2)[0])
        return df.where(F.col(text).rlike(pattern)).select(key, F.lit(name).alias("rule"), hits[0].alias("match"), F.size(hits).cast("long").alias("n_matches"), at.cast("long").alias("first_index"))

    return reduce(DataFrame.unionByName, [rule("banned-language", vocab.BANNED_COPY.replace(r"\b", WORD_EDGE)), rule("em-dash", vocab.EM_DASH)])


def firm_footprint(contacts: DataFrame) -> DataFrame:
    """Per license: contact rows, distinct permits and rows as contractor."""
    return contacts.where("license IS NOT NULL").groupBy("license").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("permit_number").alias("n_permits"), F.count_if(F.col("role") == "contractor").alias("n_as_contractor"))


def discipline_of_record(contacts: DataFrame, prefix: str, role: str = "engineer") -> DataFrame:
    """Per permit whether a row of the role carries a license with this prefix, whatever its case."""
    hit = (F.col("role") == role) & (F.upper(F.left(F.col("license"), F.lit(len(prefix)))) == prefix.upper())
    return contacts.groupBy("permit_number").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("has_discipline"))


def valuation_rank(survivors: DataFrame, value: str, k: int) -> DataFrame:
    """Of each profile's survivors the k largest with their rank: one more than the number of larger ones."""
    own = Window.partitionBy("profile_id")
    top = survivors.withColumn("_n", F.row_number().over(own.orderBy(F.desc(value), "permit_number"))).where(F.col("_n") <= k).drop("_n")
    return top.withColumn("valuation_rank", F.rank().over(own.orderBy(F.desc(value))))
