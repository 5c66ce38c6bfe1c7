"""The fifth round: profiles that are alike are judged and folded once, and pairs don't move after they are made."""

import re

from pyspark.sql import functions as F
from sievewright.operators import gates
from sievewright.plans import queries  # noqa: F401
from sievewright.plans.bindings import NOW, frame
from sievewright.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def _copies(spark):
    """Profiles, each three times over, and how many there were."""
    profiles = frame(spark, SF, "profiles")
    return profiles.crossJoin(spark.range(3).withColumnRenamed("id", "_copy")).withColumn("profile_id", F.col("profile_id") * 10 + F.col("_copy")).drop("_copy")


def _folded(monkeypatch):
    """What folded_sites() was given, in rows."""
    seen, real = [], gates.folded_sites
    monkeypatch.setattr(gates, "folded_sites", lambda rows, *more: seen.append(rows.count()) or real(rows, *more))
    return seen


def test_pairs_do_not_move_for_their_marks(spark):
    for name in ("g6_dedupe", "g7_gate_sheet", "g8_rejection_summary"):
        assert not re.search(r"Join LeftOuter.*profile_id", _plan(spark, name)), name  # all that pass five gates were joined with the accepted ones


def test_the_sheet_folds_alike_profiles_once(spark, monkeypatch):
    seen, records = _folded(monkeypatch), frame(spark, SF, "valued").select(*gates.READ)
    cols = ("permit_number", "rejected_by", "reason")
    one = sorted(map(tuple, gates.gate_sheet(records, frame(spark, SF, "profiles"), NOW).select("profile_id", *cols).collect()), key=str)
    many = gates.gate_sheet(records, _copies(spark), NOW).select("profile_id", *cols).collect()
    assert seen[0] == seen[1]  # was three times as many
    for copy in range(3):
        assert sorted(((r.profile_id // 10, r.permit_number, r.rejected_by, r.reason) for r in many if r.profile_id % 10 == copy), key=str) == one


def test_counts_fold_alike_profiles_once(spark, monkeypatch):
    seen, records = _folded(monkeypatch), frame(spark, SF, "valued")
    one = {r.profile_id: tuple(r)[1:] for r in gates.survivor_counts(records, frame(spark, SF, "profiles"), NOW).collect()}
    many = gates.survivor_counts(records, _copies(spark), NOW).collect()
    assert seen[0] == seen[1] and len(many) == 3 * len(one)  # was three times as many
    assert all(tuple(r)[1:] == one[r.profile_id // 10] for r in many)


def test_counts_make_only_sets_of_places_that_are_asked_for(spark):
    rows = spark.createDataFrame([(1, ["z1", "d2", "d3"]), (2, ["z1"])], "k int, _spots array<string>")
    sets = lambda *places: sorted(("".join(r["_all"]), r["_sign"]) for r in gates._cells(rows, [], gates._asked_for(spark.createDataFrame([(p,) for p in places], "_places array<string>"))).collect())
    alone = [("d2", 1), ("d3", 1), ("z1", 1), ("z1", 1)]
    assert sets(["z1"], ["d2"]) == alone  # all eight were made
    assert sets(["z1"], ["o"]) == sorted([*alone, ("o", 1), ("o", 1)])
    assert sets(["d2", "d3"]) == sorted([*alone, ("d2d3", -1)])
    assert sets(["z1", "d2", "d3"]) == sorted([*alone, ("d2d3", -1), ("d2z1", -1), ("d3z1", -1), ("d2d3z1", 1)])


def test_ranks_are_found_once_for_alike_profiles(spark):
    assert "_as" in _plan(spark, "a14_valuation_rank").split("Window")[0]  # every profile's pairs were ranked, and all met their marks


def test_records_are_judged_by_code_that_is_compiled(spark, monkeypatch):
    made, real = [], gates.stored
    monkeypatch.setattr(gates, "stored", lambda df, name: made.append((name, df)) or real(df, name))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("g8_rejection_summary", "g10_rejections_by_gate"):
            QUERIES[name](spark, SF)
        shown = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$")
        text = "".join(shown.codegenString(df._jdf.queryExecution().executedPlan()) for name, df in made if name == "judged")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) <= 8000  # was 21,125 for the sheet


def test_funnel_stream_writes_alike_profiles_once(spark, monkeypatch):
    from sievewright.streaming import streams

    written, real = [], streams.collected
    monkeypatch.setattr(streams, "collected", lambda stream, folder, *mode: written.append(real(stream, folder, *mode)) or written[-1])
    found = QUERIES["t6_stream_funnel"](spark, SF).count()
    assert {c for df in written for c in df.columns} >= {"failed"} and written[-1].count() < found  # a row for every profile was written


def test_state_of_the_funnel_is_packed(spark):
    import pandas as pd
    from sievewright.streaming import streams

    class State(list):
        get, exists = list.copy, list.__len__

        def appendList(self, rows):  # noqa: N802
            self.extend(rows)

    one = streams._Accepted()
    one.taken = State()
    none = streams.NO_BUCKET
    one.handleInitialState((0,), pd.DataFrame({"profile_id": [1, 2], "site": [b"s" * 15 + b"\0", b"t" * 16], "bucket": [4, none]}), None)
    rows = pd.DataFrame([(1, b"s" * 15 + b"\0", "a", 5, 1), (1, b"t" * 16, "b", none, 2), (2, b"t" * 16, "c", none, 3), (1, b"s" * 15 + b"\0", "e", 7, 5), (1, b"s" * 15 + b"\0", "d", 6, 4)], columns=["profile_id", "site", "permit_number", "bucket", "arrival"])
    judged = pd.concat(one.handleInputRows((0,), iter([rows]), None))
    assert dict(zip(judged["permit_number"], judged["rejected_by"], strict=True)) == {"a": "dedupe", "b": None, "c": "dedupe", "d": None, "e": "dedupe"}
    assert len(one.taken) == 2 and {type(x) for (x,) in one.taken} == {bytes}  # was an entry for each filing
    assert sum(len(x) for (x,) in one.taken) == 32 * 4


def test_pairs_are_scored_by_code_that_is_compiled(spark):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        shown = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$")
        for name in ("c11_components", "c13_top_drivers"):
            sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", shown.codegenString(QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan()))]
            assert sizes and max(sizes) <= 8000, name  # were 9,828 and 8,887
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
