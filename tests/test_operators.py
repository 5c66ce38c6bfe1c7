"""Boundary rows, properties and sequential rules that the tables don't show."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievewright.functions import columns as C
from sievewright.operators import changes, enrich, feedback, gates, normalize, profile, scoring, vocab
from sievewright.sources import extract

NOW = "2026-08-15 19:00:00"


def one(spark, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in values.items()))


def test_rounding_goes_up_at_halves(spark):
    got = one(spark, a=1.005, b=-2.5, c=2.5).select(C.round2(F.col("a")), C.round_half_up(F.col("b")), C.round_half_up(F.col("c"))).first()
    assert tuple(got) == (1.0, -2.0, 3.0)


@pytest.mark.parametrize("raw,want", [("$1,234.50", 1234.5), ("1e5", None), ("NaN", None), ("5d", None), (" 7 ", 7.0), ("-3.9", -3.9), ("", None), (None, None), (".5", 0.5)])
def test_number(spark, raw, want):
    assert one(spark, x=raw).select(C.number("x")).first()[0] == want


def test_agency_time_over_clock_changes(spark):
    rows = spark.createDataFrame([("2026-03-08T02:30:00.000",), ("2026-11-01T01:30:00.000",), ("2026-02-31T00:00:00.000",), ("2026-01-01T00:00:00Z",), ("2026-01-01T00:00:00+05:30",), ("soon",), (None,)], "x string")
    got = [r[0] for r in rows.select(F.date_format(normalize.agency_timestamp("x"), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2026-03-08 10:30", "2026-11-01 08:30", None, "2026-01-01 00:00", "2025-12-31 18:30", None, None]


def test_occupancy_letters(spark):
    assert one(spark, x="B,A-2;S-1/b,9").select(normalize.occupancy_letters("x")).first()[0] == ["B", "A", "S"]


def test_read_extract(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"a": "1", "b": "x"}, {"a": "2"}]')
    rows, rejected = extract.read_extract(spark, str(tmp_path / "x.json"), ["a", "b"])
    assert sorted(map(tuple, rows.collect())) == [("1", "x"), ("2", None)]
    assert rejected.count() == 0


def test_append_only_log(spark, tmp_path):
    log = spark.createDataFrame([(1, "lead", "x", "s")], "n int, agent string, decision string, summary string").select(F.current_timestamp().alias("ts"), "agent", "decision", "summary", F.create_map(F.lit("a"), F.lit("b")).alias("refs"))
    extract.append_events(log, str(tmp_path / "log"))
    extract.append_events(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_diff_of_itself_is_empty_and_second_ingest_changes_nothing(spark):
    rows = spark.range(50).select(F.col("id").cast("string").alias("k"), F.col("id").alias("arrival"), F.md5(F.col("id").cast("string")).alias("h"), (F.col("id") % 3).alias("v"))
    assert changes.snapshot_diff(rows, rows, "k", "h", ["v"], "arrival", NOW).count() == 0
    store = rows.withColumn("first_seen_at", C.instant(NOW)).withColumn("last_seen_at", C.instant(NOW))
    assert {r[0] for r in extract.merge_snapshot(store, rows, "k", "h", NOW, ["v"]).select("merge_action").collect()} == {"unchanged"}


def greedy(rows, days=45):
    seen, out = {}, {}
    for key, site, day in rows:
        bucket = None if day is None else math.floor(day / days)
        taken = seen.setdefault(site, [])
        near = any(t == bucket or (t is not None and bucket is not None and abs(t - bucket) <= 1) for t in taken)
        out[key] = near
        if not near:
            taken.append(bucket)
    return out


def test_near_duplicates_equal_a_greedy_scan(spark):
    rng = random.Random(5)
    rows = [(i, f"s{rng.randrange(40)}", None if rng.random() < 0.1 else rng.randrange(0, 900)) for i in range(1500)]
    df = spark.createDataFrame(rows, "key long, site string, day long").withColumn("filed", F.expr("timestampadd(DAY, CAST(day AS INT), timestamp'1970-01-01 00:00:00')")).repartition(7)
    got = {r["key"]: r["near_duplicate"] for r in changes.near_duplicate_collapse(df, [], "site", F.col("filed"), "key", "key").collect()}
    assert got == greedy(rows)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2), st.sampled_from(list(vocab.EVIDENCE))), min_size=1, max_size=25))
def test_findings_merge_does_not_depend_on_partitions(spark, rows):
    df = spark.createDataFrame([(i, c, f"k{k}", e) for i, (c, k, e) in enumerate(rows)], "seq long, candidate_id long, key string, evidence string")
    got = sorted(map(tuple, enrich.merge_findings(df.repartition(5)).select("candidate_id", "key", "seq").collect()))
    best = {}
    for i, (c, k, e) in enumerate(rows):
        if (c, f"k{k}") not in best or vocab.EVIDENCE[e] > vocab.EVIDENCE[best[c, f"k{k}"][1]]:
            best[c, f"k{k}"] = (i, e)
    assert got == sorted((c, k, i) for (c, k), (i, _) in best.items())


def scored(spark, **over):
    record = dict(
        permit_number="1", description="Tenant improvement of office space: lighting, power, remodel and communication; ceiling, partition, millwork, paint, hvac, plumbing, sprinkler", existing_use="office", proposed_use="office", existing_occupancy="B", status="issued",
        valuation=8_285_917.0, stories_existing=52, stories_proposed=None, existing_units=None, proposed_units=None, zipcode="94104", supervisor_district="3", days=127.16,
        trade="electrical", profile_id=1, min_project_value=100_000.0, zips=[], districts=[], uses=["office", "retail sales"], w=1.0, n_findings=12, n_unknown=3, n_established=9, strength_sum=27, gc_value="Builder", gc_strength=3,
    )
    record |= over
    types = "permit_number string, description string, existing_use string, proposed_use string, existing_occupancy string, status string, valuation double, stories_existing int, stories_proposed int, existing_units int, proposed_units int, zipcode string, supervisor_district string, days double, trade string, profile_id int, min_project_value double, zips array<string>, districts array<string>, uses array<string>, w double, n_findings int, n_unknown int, n_established int, strength_sum int, gc_value string, gc_strength int"
    rows = spark.createDataFrame([tuple(record.values())], types)
    moved = F.when(F.col("days").isNotNull(), F.timestamp_micros(F.unix_micros(C.instant(NOW)) - (F.col("days") * 86_400_000_000).cast("long")))
    rows = rows.withColumns({"issued_date": moved, **{c: F.lit(None).cast("timestamp") for c in ("status_date", "approved_date", "filed_date", "last_activity")}, "territory_zips": F.col("zips"), "territory_districts": F.col("districts"), "preferred_uses": F.col("uses"), "weights": F.struct(*(F.col("w").alias(c) for c in scoring.COMPONENTS))})
    pairs = rows.join(scoring.scope_of_work(rows, record["trade"]).drop("trade"), "permit_number")
    return scoring.score_pairs(pairs, NOW).first()


def test_worked_example(spark):
    got = scored(spark)
    assert got["components"].asDict() == {"fit": 30.0, "demand": 25.0, "timing": 9.09, "value": 14.76, "evidence": 8.25}
    assert (got["score"], got["deliverable"], got["fatal_flags"]) == (87, True, [])
    assert abs(sum(d["delta"] for d in got["drivers"]) - 87.10) < 1e-6


@pytest.mark.parametrize("value,points", [(99_999.0, 1.0), (100_000.0, 3.0), (250_000.0, 5.0), (1_000_000.0, 7.5), (5_000_000.0, 10.0), (None, 0.0), (0.0, 0.0)])
def test_valuation_bands(spark, value, points):
    assert [d["delta"] for d in scored(spark, valuation=value)["drivers"]][3] == points


@pytest.mark.parametrize("days,points", [(0.0, 20.0), (14.0, 20.0), (180.0, 4.0), (365.0, 0.0), (400.0, 0.0), (-3.0, 20.0), (None, 6.0)])
def test_timing_curve(spark, days, points):
    assert scored(spark, days=days)["components"]["timing"] == points


@pytest.mark.parametrize("ratio,points", [(0.5, 0.0), (1.0, 3.0), (10.0, 12.0), (100.0, 15.0), (1000.0, 15.0)])
def test_value_curve(spark, ratio, points):
    assert scored(spark, valuation=ratio * 100_000)["components"]["value"] == points


def test_wrong_trade_is_no_fit(spark):
    got = scored(spark, trade="roofing")
    assert got["components"]["fit"] == 0 and not got["deliverable"] and "trade not named in scope" in got["warnings"]
    lifted = scored(spark, trade="roofing", w=1.5)  # weights over one can lift the other components
    assert lifted["score"] > got["score"]


def test_negations_do_not_count(spark):
    assert scored(spark, description="Non-electric sign, no electrical work")["components"]["fit"] < 30
    assert "electrical" not in str(scored(spark, description="Non-electric sign, no electrical work")["drivers"][1]["reason"]).split("adjacent")[0].replace("electrical scope", "")


def test_unknown_is_partial_credit_with_a_warning(spark):
    got = scored(spark, description=None, existing_use=None, proposed_use=None, existing_occupancy=None, n_findings=None, gc_strength=None, gc_value=None)
    assert got["components"]["fit"] == 4.0
    assert {"description empty", "use not published", "no findings", "no general contractor finding"} <= set(got["warnings"])


def test_flags_never_touch_the_score(spark):
    plain, flagged = scored(spark), scored(spark, zips=["94999"])
    assert flagged["score"] == plain["score"] and flagged["fatal_flags"] == ["territory.mismatch"] and not flagged["deliverable"]


@pytest.mark.parametrize("w,want", [(0.0, 0), (3.0, 100), (4.0, 100), (float("nan"), 87)])
def test_weights_are_clamped(spark, w, want):
    assert scored(spark, w=w)["score"] == want


def test_terms_with_a_trailing_blank_need_punctuation(spark):
    rows = spark.createDataFrame([("1", "Demo (e) wall"), ("2", "Demo wall")], "permit_number string, description string")
    got = {r["permit_number"]: r["domains"] for r in scoring.scope_of_work(rows, "general_building").collect()}
    assert "demolition" in got["1"] and "demolition" not in got["2"]


def test_weight_fold_regresses_and_clamps(spark):
    rows = spark.createDataFrame([(1, f"2024-01-0{i} 00:00:00", i, v) for i, v in enumerate(["too_small"] * 4 + ["good"], 1)], "c long, ts string, n long, v string").withColumn("ts", F.col("ts").cast("timestamp"))
    last = feedback.fold_weights(rows, "c", "ts", "v", "n").orderBy("tie").collect()[-1]
    assert last["before"]["value"] == 1.5 and last["after"]["value"] == 1.38


def test_copy_audit_positions(spark):
    rows = spark.createDataFrame([(1, "é agent — GPT"), (2, "a fine reagent"), (3, None)], "k int, t string")
    got = sorted(map(tuple, profile.copy_policy_audit(rows, "k", "t").collect()))
    assert got == [(1, "banned-language", "agent", 2, 2), (1, "em-dash", "—", 1, 8)]


def test_narrower_territory_accepts_a_subset(spark):
    rows = spark.createDataFrame([(str(i), f"941{i:02d}", str(i % 4), f"place {i}") for i in range(40)], "permit_number string, zipcode string, supervisor_district string, neighborhood string")
    wide, narrow = F.array(*(F.lit(f"941{i:02d}") for i in range(20))), F.array(*(F.lit(f"941{i:02d}") for i in range(5)))
    none = F.array().cast("array<string>")
    passed = lambda z: {r[0] for r in rows.where(gates.geography_gate(F.col("zipcode"), F.col("supervisor_district"), F.col("neighborhood"), z, none)["passed"]).select("permit_number").collect()}
    assert passed(narrow) < passed(wide)
    assert len(passed(none)) == 40


def _records(spark, rows):
    return spark.createDataFrame(rows, "permit_number string, zipcode string, supervisor_district string, neighborhood string")


def _profiles(spark, rows):
    return spark.createDataFrame(rows, "profile_id long, territory_zips array<string>, territory_districts array<string>")


def test_places_are_compared_in_their_normal_forms(spark):
    records = _records(spark, [("a", "CA 94104", None, None), ("b", "94104-1234", "09", None), ("c", None, "9.0", None), ("d", None, "Supervisor  District 9", "Mission \u2013 Bay"), ("e", None, None, None), ("f", "941", "x", " mission - BAY ")])
    profiles = _profiles(spark, [(1, ["94104"], ["9"]), (2, [], ["District 009"]), (3, ["94104-0000"], []), (4, [" "], ["Mission \u2014 bay"]), (5, [], None), (6, None, ["10"])])
    pairs = records.crossJoin(profiles)
    gate = gates.geography_gate(*(F.col(c) for c in ("zipcode", "supervisor_district", "neighborhood", "territory_zips", "territory_districts")))
    passed = {(r.permit_number, r.profile_id) for r in pairs.where(gate["passed"]).collect()}
    assert {p for p, i in passed if i == 1} == {"a", "b", "d"} and {p for p, i in passed if i == 2} == {"b", "d"} and {p for p, i in passed if i == 3} == {"a", "b"}
    assert {p for p, i in passed if i == 4} == {"d", "f"} and {p for p, i in passed if i == 5} == set("abcdef") and not {p for p, i in passed if i == 6}
    met = [(r.permit_number, r.profile_id) for r in gates.pair_up(records, profiles).collect()]
    assert len(met) == len(set(met)) and set(met) == passed
    assert gates.pair_up(records.limit(0), profiles).count() == gates.pair_up(records, profiles.limit(0)).count() == 0


def test_site_key_ignores_punctuation_and_dashes(spark):
    rows = spark.createDataFrame([("1", "12\u201314 Main St", None, "Install T.I. lighting, 2nd floor."), ("2", "12-14  main st ", "", "INSTALL T I LIGHTING 2ND FLOOR"), ("3", "12-14 main st", "5", "Install T.I. lighting, 2nd floor."), ("4", None, None, "x"), ("5", None, None, "x"), ("6", "a st", None, " ?! ")], "k string, address string, unit string, description string")
    keys = {r.k: r.s for r in rows.select("k", changes.site_key(F.col("address"), F.col("unit"), F.col("description"), F.col("k")).alias("s")).collect()}
    assert keys["1"] == keys["2"] and len(set(keys.values())) == 5
    parts = rows.limit(1).select(changes.site_key(F.lit(None).cast("string"), F.col("unit"), F.col("description"), F.col("k"), (F.lit("12-14"), F.lit(None).cast("string"), F.lit("Main"), F.lit("ST"))).alias("s"))
    assert parts.first().s == keys["1"]


def test_sheet_equals_the_product(spark):
    from sievewright.plans.bindings import NOW as now
    from sievewright.plans.bindings import frame

    sf = "/root/testdata/sf0.001"
    records, profiles = frame(spark, sf, "valued").where("arrival < 300"), frame(spark, sf, "profiles").where("profile_id < 20")
    whole = gates.five_gates(records.crossJoin(profiles), now).select("profile_id", "permit_number", F.get(F.filter("outcomes", lambda o: ~o["passed"]), F.lit(0))["gate"].alias("gate")).collect()
    want = {(r.profile_id, r.permit_number): r.gate for r in whole if r.gate != "geography"}
    sheet = gates.gate_sheet(records, profiles, now).select("profile_id", "permit_number", F.nullif("rejected_by", F.lit("dedupe")).alias("gate"), F.get(F.filter("outcomes", lambda o: ~o["passed"]), F.lit(0))["gate"].alias("first"), "rejected_by").collect()
    assert {(r.profile_id, r.permit_number): r.gate for r in sheet} == want and all(r["first"] == r.rejected_by for r in sheet)
    counts = {(r.profile_id, r.rejected_by): r.n for r in gates.rejections_by_gate(gates.survivor_counts(records, profiles, now)).collect()}
    for p in range(20):
        assert counts.get((p, "geography"), 0) == sum(r.gate == "geography" for r in whole if r.profile_id == p)


def test_funnel_has_no_product(spark, capsys):
    from sievewright.plans.queries import QUERIES

    QUERIES["g9_funnel"](spark, "/root/testdata/sf0.001").explain("formatted")
    plan = capsys.readouterr().out
    assert plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_weights_fold_in_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, None]), i, rng.choice([*feedback.MOVES, "good", "other", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "c long, n long, v string").withColumn("ts", F.timestamp_seconds(F.col("n") % 7)).repartition(5)
    got = {r.tie: r for r in feedback.fold_weights(df, "c", "ts", "v", "n").collect()}
    assert len(got) == 300
    for c in (1, 2, None):
        w = [1.0] * 5
        for _, n, v in sorted((n % 7, n, v) for x, n, v in rows if x == c):
            assert list(got[n].before) == w
            w = feedback.moved(w, v)
            assert list(got[n].after) == w
