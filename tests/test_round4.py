"""Plans and results of the fourth round: what is found once per record stays out of the pairs."""

from sievewright.plans.registry import QUERIES
from sievewright.plans import queries  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_pairs_do_not_move_for_their_scope_and_reasons_are_left_out(spark):
    df = QUERIES["c11_components"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "partial credit" not in plan  # reasons were built for every pair, though only codes are asked for
    executed = df._jdf.queryExecution().executedPlan().toString()
    first = next(line for line in executed.splitlines() if "Join" in line)
    assert "BroadcastHashJoin" in first and "scope_number" in first  # was a sort-merge join by description


def test_pairs_that_fail_a_gate_do_not_move_for_the_fold(spark):
    plan = lambda name: QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    g8 = plan("g8_rejection_summary").splitlines()
    assert "Union" in g8[0] + g8[1]  # all pairs met the marks of the fold in one wide join
    assert "sha2" not in plan("a10_shortlist_profile")  # sites were folded, though the shortlist keeps repeats


def test_state_of_the_funnel_is_dealt_in_shares(spark, tmp_path):
    from sievewright.plans.bindings import NOW, frame
    from sievewright.streaming import streams

    records = frame(spark, SF, "valued")
    stream = streams.file_stream(spark, str(tmp_path), records.schema)
    plan = streams.stream_funnel(stream, frame(spark, SF, "profiles"), NOW)._jdf.queryExecution().analyzed().toString()
    assert "pmod(xxhash64(profile_id" in plan  # each profile and site was a group of its own


def test_what_takes_nothing_from_a_scope_looks_for_none(spark):
    for name in ("c6_timing", "c7_value", "c8_evidence", "c9_fatal_flags"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "scope_number" not in plan and "description" not in plan, name  # every pair met its scope, which gave nothing


def test_passes_with_history_find_sites_once(spark, monkeypatch):
    from sievewright.plans import q_changes

    plans, real = [], q_changes.stored
    monkeypatch.setattr(q_changes, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or real(df, name))
    assert QUERIES["d9_accepted_history"](spark, SF).count() == 1500
    assert [name for name, plan in plans if "sha2" in plan] == ["sites"]  # each pass joined orders and hashed sites again
