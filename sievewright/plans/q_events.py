"""Queries over feedback, economics, the ledger, the queue and billing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feedback as W
from ..operators import ledger as B
from ..operators import vocab
from .bindings import frame, with_roles
from .q_leads import _ATT, _attributed
from .registry import query

REP, VER, LOG, OPP = with_roles("replies"), with_roles("verdicts"), with_roles("log"), with_roles("opportunities")
_BODY = "TRIM(REGEXP_REPLACE(REGEXP_REPLACE(LOWER(text), '''', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "w1_classify_replies",
    REP + f"""SELECT reply_id, CASE WHEN body IN ({', '.join(f"'{k}'" for k in vocab.OPT_OUT_WHOLE)}) OR REGEXP_MATCHES(body, '{vocab.OPT_OUT_PATTERN}') THEN 'opt_out' {' '.join(f"WHEN REGEXP_MATCHES(body, '{p}') THEN '{k}'" for k, p in vocab.REPLY_PATTERNS.items())} ELSE 'unrecognised' END AS verdict FROM (SELECT *, {_BODY} AS body FROM replies)""",
)
def _(spark, d):
    return W.classify_replies(frame(spark, d, "replies"), "text").select("reply_id", "verdict")


@query("w2_feedback_transitions", VER + ", l AS (SELECT *, LAG(verdict) OVER (PARTITION BY opportunity_id ORDER BY ts, event_id) AS b FROM verdicts) SELECT event_id, CASE WHEN b IS NULL THEN 'recorded' WHEN b = verdict THEN 'reaffirmed' ELSE 'changed' END AS transition FROM l")
def _(spark, d):
    return W.feedback_transitions(frame(spark, d, "verdicts"), "opportunity_id", "ts", "verdict", "event_id").select("event_id", "transition")


def _step(name: str) -> str:
    w = f"w.{name}"
    bound = "FLOOR(LEAST(1.5, GREATEST(0.5, {0})) * 100 + 0.5) / 100".format
    out = f"CASE v.verdict WHEN 'good' THEN {bound(f'{w} + (1.0 - {w}) * 0.25')}"
    for kind, moves in W.MOVES.items():
        if name in moves:
            out += f" WHEN '{kind}' THEN {bound(f'{w} + ({moves[name]})')}"
    return out + f" ELSE {w} END"


_FOLD = VER.replace("WITH ", "WITH RECURSIVE ", 1) + f""", v AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY ts, event_id) AS n FROM verdicts),
    fold AS (SELECT DISTINCT customer_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, {', '.join(f'CAST(1.0 AS DOUBLE) AS {c}' for c in W.NAMES)} FROM v
        UNION ALL SELECT w.customer_id, v.n, v.event_id, {', '.join(f'CAST({_step(c)} AS DOUBLE)' for c in W.NAMES)} FROM fold w JOIN v ON v.customer_id = w.customer_id AND v.n = w.n + 1) """


@query("w3_fold_weights", _FOLD + "SELECT customer_id, event_id, fit, demand, timing, value, evidence FROM fold WHERE n > 0")
def _(spark, d):
    return W.fold_weights(frame(spark, d, "verdicts"), "customer_id", "ts", "verdict", "event_id").select("customer_id", F.col("tie").alias("event_id"), "after.*")


@query("w4_unsettled_feedback", with_roles("verdicts", "log") + "SELECT event_id, opportunity_id FROM verdicts WHERE CAST(opportunity_id AS STRING) NOT IN (SELECT ref_opportunity FROM log WHERE decision IN ('weights.applied', 'weights.noop')) ORDER BY ts, opportunity_id LIMIT 40")
def _(spark, d):
    return W.unsettled_feedback(frame(spark, d, "verdicts"), frame(spark, d, "log"), 40, "opportunity_id", "ts").select("event_id", "opportunity_id")


@query("w5_weight_moves", _FOLD + ", last AS (SELECT * FROM fold f WHERE n = (SELECT MAX(n) FROM fold g WHERE g.customer_id = f.customer_id)) SELECT customer_id, component, weight, CASE WHEN weight > 1 THEN 'up' ELSE 'down' END AS direction FROM (UNPIVOT last ON fit, demand, timing, value, evidence INTO NAME component VALUE weight) WHERE weight <> 1")
def _(spark, d):
    folded = W.fold_weights(frame(spark, d, "verdicts"), "customer_id", "ts", "verdict", "event_id")
    last = folded.groupBy("customer_id").agg(F.max_by("after", F.struct("ts", "tie")).alias("after"))
    return W.weight_moves(last, "customer_id")


_BILL = with_roles("billing") + """, once AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY provider_event ORDER BY arrival) AS n FROM billing) WHERE n = 1),
    states AS (SELECT customer_id, ARG_MAX(CASE WHEN provider_status IN ('active', 'trialing') THEN 'active' WHEN provider_status IN ('past_due', 'unpaid', 'paused') THEN 'past_due' WHEN provider_status IN ('canceled', 'incomplete_expired') THEN 'canceled' ELSE 'pending' END, arrival) AS state, MAX(ts) AS updated_at FROM once GROUP BY 1) """


def _state(spark, d):
    return B.billing_state(B.billing_events_once(frame(spark, d, "billing"), "provider_event", ["arrival"]), ["arrival"])


_COUNTS = "COUNT(*) FILTER (WHERE status = 'delivered') AS delivered, COUNT(*) FILTER (WHERE status = 'archived') AS archived, COUNT(*) FILTER (WHERE status = 'pending') AS pending"


@query(
    "e1_company_economics",
    _BILL + ", " + OPP[5:] + f"""SELECT s.*, o.*, CASE WHEN replies > 0 THEN FLOOR(10000.0 * accepted / replies + 0.5) / 100 END AS acceptance_pct FROM (SELECT COUNT(*) FILTER (WHERE state = 'active') AS active_subscribers, CAST(149.0 * COUNT(*) FILTER (WHERE state = 'active') AS DOUBLE) AS mrr FROM states) s,
        (SELECT {_COUNTS}, COUNT(feedback) AS replies, COUNT(*) FILTER (WHERE feedback = 'good') AS accepted FROM opportunities) o""",
)
def _(spark, d):
    return W.company_economics(frame(spark, d, "opportunities"), _state(spark, d))


_SEGS = _ATT + """, segs AS (SELECT COALESCE(existing_use, proposed_use, 'use not published') AS segment, COUNT(*) FILTER (WHERE status = 'delivered') AS delivered, COUNT(*) FILTER (WHERE status = 'archived') AS archived, COUNT(*) FILTER (WHERE feedback = 'good') AS accepted,
    COUNT(*) FILTER (WHERE feedback IN ('too_small', 'wrong_scope')) AS rejected, FLOOR(AVG(score) FILTER (WHERE status = 'delivered') * 100 + 0.5) / 100 AS mean_delivered_score FROM att GROUP BY 1),
    ranked AS (SELECT *, CAST(delivered + 3.0 * accepted - 2.0 * rejected - 0.25 * archived AS DOUBLE) AS rank FROM segs) """


@query("e2_segment_economics", _SEGS + "SELECT * FROM ranked")
def _(spark, d):
    return W.segment_economics(_attributed(spark, d))


@query("e3_choose_allocation", _SEGS + "SELECT segment, rank FROM ranked WHERE (SELECT COUNT(DISTINCT rank) FROM ranked) > 1 OR (SELECT COUNT(*) FROM ranked) = 1 ORDER BY rank DESC, delivered DESC, segment LIMIT 1")
def _(spark, d):
    return W.choose_allocation(W.segment_economics(_attributed(spark, d))).select("segment", "rank")


@query(
    "e4_current_allocation",
    LOG + """, a AS (SELECT ref_segment AS segment, ts, ROW_NUMBER() OVER (ORDER BY ts DESC, event_id DESC) AS n FROM log WHERE decision = 'allocation.set' AND ref_segment IS NOT NULL)
    SELECT x.segment, CASE WHEN y.segment IS NULL THEN 'first' WHEN y.segment = x.segment THEN 'unchanged' ELSE 'moved' END AS movement FROM a x LEFT JOIN a y ON y.n = 2 WHERE x.n = 1""",
)
def _(spark, d):
    return W.current_allocation(frame(spark, d, "log"), "event_id").select("segment", "movement")


@query(
    "e5_account_lines",
    _BILL + ", " + with_roles("opportunities")[5:] + f""", c AS (SELECT c_custkey AS customer_id, c_name AS business_name FROM customer)
    SELECT c.customer_id, c.business_name, COALESCE(s.state, 'none') AS state, COALESCE(delivered, 0) AS delivered, COALESCE(archived, 0) AS archived, COALESCE(pending, 0) AS pending, COALESCE(f_good, 0) AS f_good, COALESCE(f_too_small, 0) AS f_too_small, COALESCE(f_wrong_scope, 0) AS f_wrong_scope,
        CASE WHEN s.state = 'active' THEN CAST(149.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS monthly_revenue FROM c LEFT JOIN states s ON s.customer_id = c.customer_id
        LEFT JOIN (SELECT customer_id, {_COUNTS}, COUNT(*) FILTER (WHERE feedback = 'good') AS f_good, COUNT(*) FILTER (WHERE feedback = 'too_small') AS f_too_small, COUNT(*) FILTER (WHERE feedback = 'wrong_scope') AS f_wrong_scope FROM opportunities GROUP BY 1) o ON o.customer_id = c.customer_id""",
)
def _(spark, d):
    customers = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS customer_id", "c_name AS business_name")
    return W.account_lines(customers, _state(spark, d), frame(spark, d, "opportunities"))


@query("e6_ops_counters", with_roles("opportunities", "records") + f"SELECT o.*, (SELECT COUNT(*) FROM customer) AS subscribers, (SELECT COUNT(*) FROM records) AS records, TRUE AS any_replayed FROM (SELECT {_COUNTS} FROM opportunities) o")
def _(spark, d):
    records = frame(spark, d, "records").withColumn("provenance", F.struct((F.col("arrival") % 2 == 0).alias("replayed")))
    return W.ops_counters(frame(spark, d, "opportunities"), spark.read.parquet(f"{d}/customer.parquet"), records)


_QS = ["trust", "clarity", "reply"]
_TALLY = with_roles("responses") + f""", tally AS (SELECT variant_id, {', '.join(f"COUNT(*) FILTER (WHERE question = '{q}') AS {q}" for q in _QS)}, {', '.join(f"FLOOR(10000.0 * COUNT(*) FILTER (WHERE question = '{q}') / (SELECT COUNT(*) FROM responses WHERE question = '{q}') + 0.5) / 100 AS {q}_share" for q in _QS)}, COUNT(*) AS total_selections FROM responses GROUP BY 1) """


@query("e7_study_tally", _TALLY + "SELECT * FROM tally")
def _(spark, d):
    return W.study_tally(frame(spark, d, "responses"), _QS)


@query("e8_study_winner", _TALLY + "SELECT variant_id, total_selections FROM tally WHERE total_selections > 0 ORDER BY total_selections DESC, trust DESC, clarity DESC, reply DESC, variant_id LIMIT 1")
def _(spark, d):
    return W.study_winner(W.study_tally(frame(spark, d, "responses"), _QS), _QS).select("variant_id", "total_selections")


@query("e9_event_log", LOG + "SELECT event_id, decision FROM log WHERE agent = 'view' ORDER BY ts DESC, event_id DESC LIMIT 60")
def _(spark, d):
    return W.event_log(frame(spark, d, "log"), 60, "view").select("event_id", "decision")


_SUMMARY = "TRIM(REGEXP_REPLACE(REGEXP_REPLACE(summary, '\\s*[—―]\\s*', ', ', 'g'), '\\s+', ' ', 'g'))"


@query("e10_clean_summaries", LOG + f"SELECT event_id, CASE WHEN LENGTH({_SUMMARY}) > 400 THEN CONCAT(RTRIM(SUBSTR({_SUMMARY}, 1, 397)), '...') ELSE {_SUMMARY} END AS summary FROM log")
def _(spark, d):
    return W.clean_summaries(frame(spark, d, "log"), "summary").select("event_id", "summary")


@query("e11_decision_counts", LOG + "SELECT agent, decision, COUNT(*) AS n FROM log GROUP BY 1, 2")
def _(spark, d):
    return W.decision_counts(frame(spark, d, "log"))


_LED = with_roles("messages", "queue") + ", ledger AS (SELECT handle, MIN(ts) AS first_seen, MAX(ts) AS last_seen, COUNT(*) FILTER (WHERE kind = 'inbound') AS message_count, BOOL_OR(opt_out) AS opted_out, MIN(ts) FILTER (WHERE opt_out) AS opted_out_at FROM messages GROUP BY 1) "


@query("b1_contact_ledger", _LED + "SELECT handle, CAST(first_seen AS STRING) AS first_seen, CAST(last_seen AS STRING) AS last_seen, message_count, opted_out, CAST(opted_out_at AS STRING) AS opted_out_at FROM ledger")
def _(spark, d):
    out = B.contact_ledger(frame(spark, d, "messages"))
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_seen", "last_seen", "opted_out_at")})


@query("b2_reachable", _LED + "SELECT handle FROM ledger WHERE message_count > 0 AND NOT opted_out")
def _(spark, d):
    return B.reachable(B.contact_ledger(frame(spark, d, "messages"))).select("handle")


_ADM = _LED + """, ep AS (SELECT *, COALESCE(SUM(CASE WHEN action <> 'enqueue' THEN 1 ELSE 0 END) OVER (PARTITION BY handle, purpose ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM queue),
    adm AS (SELECT *, CASE WHEN action <> 'enqueue' THEN 'release' WHEN ROW_NUMBER() OVER (PARTITION BY handle, purpose, epoch, action = 'enqueue' ORDER BY event_id) = 1 THEN 'admitted' ELSE 'duplicate' END AS admission FROM ep),
    pend AS (SELECT a.* FROM adm a WHERE admission = 'admitted' AND NOT EXISTS (SELECT 1 FROM queue r WHERE r.handle = a.handle AND r.purpose = a.purpose AND r.action <> 'enqueue' AND r.event_id > a.event_id)) """


def _admitted(spark, d):
    return B.admit_queue(frame(spark, d, "queue"), ["event_id"])


@query("b3_admit_queue", _ADM + "SELECT event_id, admission FROM adm")
def _(spark, d):
    return _admitted(spark, d).select("event_id", "admission")


@query("b4_pending_for", _ADM + "SELECT event_id, purpose FROM pend WHERE handle = 'h7'")
def _(spark, d):
    return B.pending_for(B.pending_rows(_admitted(spark, d), ["event_id"]), "h7", ["event_id"]).select("event_id", "purpose")


@query("b4_count_pending", _ADM + "SELECT purpose, COUNT(*) AS n_pending FROM pend GROUP BY 1")
def _(spark, d):
    return B.count_pending(B.pending_rows(_admitted(spark, d), ["event_id"]))


@query("b5_releasable", _ADM + "SELECT p.event_id FROM pend p JOIN ledger l ON l.handle = p.handle WHERE l.message_count > 0 AND NOT l.opted_out AND l.last_seen > p.ts")
def _(spark, d):
    return B.releasable(B.pending_rows(_admitted(spark, d), ["event_id"]), B.contact_ledger(frame(spark, d, "messages"))).select("event_id")


@query("b6_billing_events_once", _BILL + "SELECT provider_event, arrival FROM once")
def _(spark, d):
    return B.billing_events_once(frame(spark, d, "billing"), "provider_event", ["arrival"]).select("provider_event", "arrival")


@query("b7_billing_state", _BILL + "SELECT customer_id, state, CAST(updated_at AS STRING) AS updated_at FROM states")
def _(spark, d):
    return _state(spark, d).withColumn("updated_at", F.col("updated_at").cast("string"))


@query("b8_active_customers", _BILL + "SELECT customer_id FROM states WHERE state = 'active'")
def _(spark, d):
    return B.active_customers(_state(spark, d))


@query("b9_primary_customer", _BILL + "SELECT customer_id FROM states ORDER BY (state = 'active') DESC, updated_at, customer_id LIMIT 1")
def _(spark, d):
    return B.primary_customer(_state(spark, d).withColumnRenamed("updated_at", "created_at")).select("customer_id")
