"""Feedback and economics: replies to verdicts, verdicts to weights, segments, allocation, accounts, studies, the log."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import round2
from ..sources.shared import stored
from . import vocab
from .ranking import positions

NAMES = ("fit", "demand", "timing", "value", "evidence")
#: How a verdict moves the weights.
MOVES = {"too_small": {"value": 0.2, "demand": 0.1, "timing": -0.05}, "wrong_scope": {"fit": 0.25, "evidence": 0.1, "demand": -0.05}}
LOW, HIGH, REGRESS = 0.5, 1.5, 0.25


def classify_replies(df: DataFrame, text: str) -> DataFrame:
    """Adds verdict: opt_out, too_small, wrong_scope, good or unrecognised; the first that fits, in this order."""
    body = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "['‘’`]", ""), "[^a-z0-9]+", " "))
    out = F.when(body.isin(*vocab.OPT_OUT_WHOLE) | body.rlike(vocab.OPT_OUT_PATTERN), "opt_out")
    for verdict, pattern in vocab.REPLY_PATTERNS.items():
        out = out.when(body.rlike(pattern), verdict)
    return df.withColumn("verdict", out.otherwise("unrecognised"))


def feedback_transitions(feedback: DataFrame, opportunity: str, ts: str, verdict: str, tie: str) -> DataFrame:
    """Adds transition: recorded at first, reaffirmed if the same as before, changed otherwise."""
    before = F.lag(verdict).over(Window.partitionBy(opportunity).orderBy(ts, tie))
    return feedback.withColumn("transition", F.when(before.isNull(), "recorded").when(before == F.col(verdict), "reaffirmed").otherwise("changed"))


def moved(weights: list[float], verdict: str | None) -> list[float]:
    """The five weights after one verdict: good draws all back to 1, others move some; bounded, rounded half up."""
    moves = MOVES.get(verdict, {})
    out = []
    for name, w in zip(NAMES, weights, strict=True):
        new = w + (1.0 - w) * REGRESS if verdict == "good" else w + moves[name] if name in moves else None
        out.append(w if new is None else math.floor(min(HIGH, max(LOW, new)) * 100 + 0.5) / 100)
    return out


#: Verdicts of a chunk, and chunks (or groups) of a group above: what one array holds at most.
CHUNK = 256
_STATES = range(round(LOW * 100), round(HIGH * 100) + 1)
_FIRST = 100 - _STATES[0]  # a weight of 1


def _moves() -> dict[str, list[list[int]]]:
    """Per verdict and component, the number of the weight that each weight moves to: a weight has 101 values only."""
    out = {}
    for verdict in ("good", *MOVES):
        after = [moved([w / 100] * len(NAMES), verdict) for w in _STATES]
        out[verdict] = [[round(a[i] * 100) - _STATES[0] for a in after] for i in range(len(NAMES))]
    return out


def _next(state: Column, verdict: Column, component: int) -> Column:
    out = state
    for name, maps in _moves().items():
        if maps[component] != list(range(len(_STATES))):
            out = F.when(verdict == name, F.element_at(F.array(*map(F.lit, maps[component])), state + 1)).otherwise(out)
    return out


def _map(numbers: Column, steps: str, step: Callable[[Column, Column, int], Column], component: int) -> Column:
    """Where the steps, one after the other, take each weight of a component."""
    return F.transform(numbers, lambda s: F.aggregate(steps, s, lambda acc, x: step(acc, x, component)))


def _applied(maps: Column, states: Column) -> Column:
    """Five states after five maps."""
    return F.transform(maps, lambda m, i: F.element_at(m, F.get(states, i) + 1))


def _grouped(maps: DataFrame) -> DataFrame:
    """who, at and kids (CHUNK maps in order) one level up."""
    return maps.groupBy("who", F.floor(F.col("at") / CHUNK).cast("long").alias("up")).agg(F.sort_array(F.collect_list(F.struct("at", "m"))).alias("kids"))


def _starts(maps: DataFrame) -> DataFrame:
    """who, at and start: the five states before each chunk, and after the last one, from the maps (who, at, m) of full
    chunks. Maps compose: groups of CHUNK maps become one, level by level, until a subscriber has one group; then the states
    are handed down."""
    levels = []
    while True:
        levels.append(stored(_grouped(maps), "maps"))
        top = levels[-1].agg(F.max("up").alias("up")).first()["up"]
        if not top:
            break
        numbers = F.sequence(F.lit(0), F.lit(len(_STATES) - 1))
        whole = F.array(*(_map(numbers, "kids", lambda acc, k, c: F.element_at(k["m"][c], acc + 1), c) for c in range(len(NAMES))))
        maps = levels[-1].where(F.size("kids") == CHUNK).select("who", F.col("up").alias("at"), whole.alias("m"))
    first = F.array(*(F.lit(_FIRST) for _ in NAMES))
    starts = None
    for groups in reversed(levels):
        if starts is None:
            known = groups.withColumn("start", first)
        else:
            above = starts.select(F.col("who").alias("_w"), F.col("at").alias("_u"), F.col("start").alias("_s"))
            known = groups.join(above, F.col("who").eqNullSafe(F.col("_w")) & (F.col("up") == F.col("_u")), "left").withColumn("start", F.when(F.col("up") == 0, first).otherwise(F.col("_s")))
        line = F.aggregate("kids", F.array("start"), lambda out, k: F.concat(out, F.array(_applied(k["m"], F.element_at(out, -1)))))
        each = known.select("who", "up", F.posexplode(line).alias("i", "start"))
        # what follows a full group begins where the group ends, and is known twice if it is a group itself
        starts = each.select("who", (F.col("up") * CHUNK + F.col("i")).alias("at"), "start").dropDuplicates(["who", "at"])
    return starts


def fold_weights(feedback: DataFrame, customer: str, ts: str, verdict: str, tie: str) -> DataFrame:
    """Per subscriber the weights before and after each verdict, in order of time; all begin at 1.

    Steps clamp and round, so their order matters. A weight has 101 values, so what a run of verdicts does is a map of 101
    numbers, and maps of runs that follow each other compose: a subscriber's verdicts are cut into chunks of CHUNK, the
    chunks are made into maps, the maps say with which weights each chunk begins, and the chunks are then folded side by
    side. No subscriber is one task, however many verdicts it has. Null verdicts and unknown ones change nothing; a null
    subscriber is one of its own.
    """
    rows = feedback.select(F.col(customer).alias("who"), F.col(ts).cast("timestamp").alias("ts"), F.col(tie).cast("long").alias("tie"), F.col(verdict).alias("verdict"))
    placed = positions(rows, ["who"], ["ts", "tie", "verdict"], "position")
    at = F.floor(F.col("position") / CHUNK).cast("long").alias("at")
    chunks = stored(placed.groupBy("who", at).agg(F.sort_array(F.collect_list(F.struct("ts", "tie", "verdict"))).alias("said")), "chunks")
    first = F.array(*(F.lit(_FIRST) for _ in NAMES))
    full = chunks.where(F.size("said") == CHUNK)
    if full.isEmpty():
        known = chunks.withColumn("start", first)
    else:
        numbers = F.sequence(F.lit(0), F.lit(len(_STATES) - 1))
        maps = F.array(*(_map(numbers, "said", lambda acc, x, c: _next(acc, x["verdict"], c), c) for c in range(len(NAMES))))
        starts = _starts(full.select("who", "at", maps.alias("m"))).select(F.col("who").alias("_w"), F.col("at").alias("_a"), F.col("start").alias("_s"))
        known = chunks.join(starts, F.col("who").eqNullSafe(F.col("_w")) & (F.col("at") == F.col("_a")), "left").withColumn("start", F.coalesce("_s", first))
    moved_on = lambda s, x: F.array(*(_next(s[c], x["verdict"], c) for c in range(len(NAMES))))
    line = F.aggregate("said", F.array("start"), lambda out, x: F.concat(out, F.array(moved_on(F.element_at(out, -1), x))))
    each = known.withColumn("_line", line).select("who", "_line", F.posexplode("said").alias("i", "x"))
    weights = lambda i: F.struct(*(((F.get(F.get("_line", i), F.lit(c)) + _STATES[0]) / F.lit(100.0)).alias(n) for c, n in enumerate(NAMES)))
    return each.select(F.col("who").alias(customer), "x.ts", "x.tie", "x.verdict", weights(F.col("i")).alias("before"), weights(F.col("i") + 1).alias("after"))


def unsettled_feedback(replies: DataFrame, log: DataFrame, limit: int, opportunity: str = "opportunity_id", ts: str = "reply_ts") -> DataFrame:
    """The oldest replies whose opportunity has no weights.applied or weights.noop event yet."""
    settled = log.where(F.col("decision").isin("weights.applied", "weights.noop")).select(F.col("refs")["opportunity"].alias("_o")).distinct()
    return replies.join(settled, F.col(opportunity).cast("string") == F.col("_o"), "left_anti").orderBy(ts, opportunity).limit(limit)


def weight_moves(weights: DataFrame, customer: str, column: str = "after") -> DataFrame:
    """Components whose weight differs from 1, with direction."""
    each = F.array(*(F.struct(F.lit(n).alias("component"), F.col(f"{column}.{n}").alias("weight")) for n in NAMES))
    return weights.select(customer, F.explode(each).alias("x")).select(customer, "x.*").where("weight <> 1").withColumn("direction", F.when(F.col("weight") > 1, "up").otherwise("down"))


def _accepted() -> Column:
    return F.col("feedback") == "good"


def company_economics(opportunities: DataFrame, subscriptions: DataFrame, price: float = vocab.MONTHLY_PRICE) -> DataFrame:
    """One row: active subscribers, monthly revenue, opportunities by status, replies, accepted, acceptance in percent."""
    o = opportunities.agg(
        *(F.count_if(F.col("status") == s).alias(s) for s in ("delivered", "archived", "pending")), F.count("feedback").alias("replies"), F.count_if(_accepted()).alias("accepted"),
    ).withColumn("acceptance_pct", F.when(F.col("replies") > 0, round2(100.0 * F.col("accepted") / F.col("replies"))))
    s = subscriptions.agg(F.count_if(F.col("state") == "active").alias("active_subscribers")).withColumn("mrr", F.col("active_subscribers") * price)
    return s.crossJoin(o)


def segment_economics(attributed: DataFrame) -> DataFrame:
    """Per building use: counts by outcome, mean delivered score and rank = delivered + 3 accepted - 2 rejected - archived / 4."""
    use = F.coalesce("existing_use", "proposed_use", F.lit("use not published"))
    out = attributed.groupBy(use.alias("segment")).agg(
        F.count_if(F.col("status") == "delivered").alias("delivered"), F.count_if(F.col("status") == "archived").alias("archived"), F.count_if(_accepted()).alias("accepted"),
        F.count_if(F.col("feedback").isin("too_small", "wrong_scope")).alias("rejected"), round2(F.avg(F.when(F.col("status") == "delivered", F.col("score")))).alias("mean_delivered_score"),
    )
    return out.withColumn("rank", F.col("delivered") + 3.0 * F.col("accepted") - 2.0 * F.col("rejected") - 0.25 * F.col("archived"))


def choose_allocation(segments: DataFrame) -> DataFrame:
    """The top segment by rank, delivered, name; none if there is none or all of two or more tie."""
    bounds = segments.agg(F.max("rank").alias("_hi"), F.min("rank").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    top = segments.orderBy(F.desc("rank"), F.desc("delivered"), "segment").limit(1)
    return top.crossJoin(bounds).where("NOT (_n >= 2 AND _hi = _lo)").drop("_hi", "_lo", "_n")


def current_allocation(log: DataFrame, tie: str) -> DataFrame:
    """The segment of the latest allocation.set event and whether it moved from the one before."""
    rows = log.where((F.col("decision") == "allocation.set") & F.col("refs")["segment"].isNotNull()).select("ts", F.col(tie).alias("_tie"), F.col("refs")["segment"].alias("segment"))
    latest = rows.orderBy(F.desc("ts"), F.desc("_tie")).limit(2)
    two = latest.agg(F.max_by("segment", F.struct("ts", "_tie")).alias("segment"), F.min_by("segment", F.struct("ts", "_tie")).alias("_before"), F.count(F.lit(1)).alias("_n"), F.max("ts").alias("since"))
    return two.where("_n > 0").select("segment", "since", F.when(F.col("_n") < 2, "first").when(F.col("segment") == F.col("_before"), "unchanged").otherwise("moved").alias("movement"))


def account_lines(customers: DataFrame, subscriptions: DataFrame, opportunities: DataFrame, price: float = vocab.MONTHLY_PRICE) -> DataFrame:
    """Per subscriber: billing state, revenue, opportunities by status and by feedback."""
    per = opportunities.groupBy("customer_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("delivered", "archived", "pending")), *(F.count_if(F.col("feedback") == f).alias(f"f_{f}") for f in ("good", "too_small", "wrong_scope")))
    out = customers.select("customer_id", "business_name").join(subscriptions.select("customer_id", "state"), "customer_id", "left").join(per, "customer_id", "left")
    out = out.na.fill(0, [c for c in per.columns if c != "customer_id"]).withColumn("state", F.coalesce("state", F.lit("none")))
    return out.withColumn("monthly_revenue", F.when(F.col("state") == "active", price).otherwise(0.0))


def ops_counters(opportunities: DataFrame, customers: DataFrame, records: DataFrame) -> DataFrame:
    """One row: opportunities by status, subscribers, records, and whether any record is replayed."""
    o = opportunities.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("delivered", "archived", "pending")))
    return o.crossJoin(customers.agg(F.count(F.lit(1)).alias("subscribers"))).crossJoin(records.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.bool_or("provenance.replayed"), F.lit(False)).alias("any_replayed")))


def study_tally(responses: DataFrame, questions: list[str]) -> DataFrame:
    """Per variant: selections and share per question, and the total."""
    pivot = responses.groupBy("variant_id").pivot("question", questions).agg(F.count(F.lit(1))).na.fill(0)
    total = pivot.select("variant_id", *questions, sum((F.col(q) for q in questions), F.lit(0)).alias("total_selections"))
    all_ = responses.groupBy("question").agg(F.count(F.lit(1)).alias("n"))
    totals = all_.agg(*(F.coalesce(F.max(F.when(F.col("question") == q, F.col("n"))), F.lit(0)).alias(f"_{q}") for q in questions))
    out = total.crossJoin(totals)
    return out.select("variant_id", *questions, *(F.when(F.col(f"_{q}") > 0, round2(100.0 * F.col(q) / F.col(f"_{q}"))).otherwise(0.0).alias(f"{q}_share") for q in questions), "total_selections")


def study_winner(tally: DataFrame, questions: list[str]) -> DataFrame:
    """The variant with the most selections, then by question in order, then id; none without selections."""
    return tally.where("total_selections > 0").orderBy(F.desc("total_selections"), *(F.desc(q) for q in questions), "variant_id").limit(1)


def event_log(log: DataFrame, limit: int, agent: str | None = None, tie: str = "event_id") -> DataFrame:
    rows = log if agent is None else log.where(F.col("agent") == agent)
    return rows.orderBy(F.desc("ts"), F.desc(tie)).limit(limit)


def clean_summaries(df: DataFrame, column: str, cap: int = 400) -> DataFrame:
    """Dashes of copy become commas, white space single blanks, and long ones end in three dots at the cap."""
    out = F.trim(F.regexp_replace(F.regexp_replace(F.col(column), r"(?U)\s*[—―]\s*", ", "), r"(?U)\s+", " "))
    return df.withColumn(column, F.when(F.length(out) > cap, F.concat(F.rtrim(F.substring(out, 1, cap - 3)), F.lit("..."))).otherwise(out))


def decision_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("agent", "decision").agg(F.count(F.lit(1)).alias("n"))
