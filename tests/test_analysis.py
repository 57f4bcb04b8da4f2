"""Mini-cases for transfers, peers, changes, matching and scenarios."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wavepanel.columns import PanelCols
from wavepanel.functions.similarity import edit_similarity, name_similarity, ratio
from wavepanel.functions.text import keyword_category, normalize_dept_name
from wavepanel.operators import change as CH
from wavepanel.operators import peers as P
from wavepanel.operators import scenarios as S
from wavepanel.operators import transfers as T
from wavepanel.operators.matching import tolerance_match
from wavepanel.operators.primary import entity_index

PC = PanelCols(date="d", org="org", measure="s", weight="w", seq="seq", jobcode="code")
D1, D2, D3 = dt.date(2024, 4, 1), dt.date(2024, 9, 1), dt.date(2025, 3, 1)


NORMALISED = {"Sch of Med & Public Health - Dept of Medicine": "school of medicine public health department of medicine",
              "Ag & Life Sci - Bio Sys Eng": "agricultural life science bio sys engineering",
              "  Über-Ctr ·  Info   Tech ": "über center information technology"}


def test_normalize_and_similarity(spark):
    want = NORMALISED
    df = spark.createDataFrame([(n,) for n in want], "n STRING")
    got = {r.n: r.x for r in df.select("n", normalize_dept_name("n").alias("x")).collect()}
    assert got == want
    # the matcher's ratio is 2 * matched / total: 'abcd' and 'bcde' share 'bcd'
    assert ratio("abcd", "bcde") == 0.75 and ratio("tide", "diet") == 0.25 and ratio("diet", "tide") == 0.5
    assert ratio("", "x") == 0.0 and ratio(None, "x") == 0.0


def test_previous_unit_flags_same_day_and_null(spark):
    rows = [(1, "a", D1, "X - 1"), (2, "a", D1, "X - 2"),      # two units on one date: a move
            (3, "b", D1, "Y - 1"), (4, "b", D2, None),          # null after a known unit: changed
            (5, "c", D1, "Z - 1"), (6, "c", D2, "Z - 1")]
    df = spark.createDataFrame(rows, "seq BIGINT, id STRING, d DATE, org STRING")
    out = {r.seq: r.dept_changed for r in CH.previous_value(df, PC, "org").collect()}
    assert out == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False}
    pairs = T.transfer_pairs(CH.previous_value(df, PC, "org"), PC).collect()
    assert [(r.prev_org, r.org, r.transfer_count) for r in pairs] == [("X - 1", "X - 2", 1)]


def test_previous_unit_two_level_matches_single_window(spark):
    import random
    from pyspark.sql import Window
    rnd = random.Random(5)
    rows = [(i, f"e{rnd.randrange(4)}", rnd.choice([D1, D2, D3]), rnd.choice(["A - 1", "A - 2", "B - 1", None]))
            for i in range(400)]
    df = spark.createDataFrame(rows, "seq BIGINT, id STRING, d DATE, org STRING")
    got = {r.seq: r.prev_org for r in CH.previous_value(df, PC, "org", bucket_rows=7).collect()}
    w = Window.partitionBy("id").orderBy("d", "seq")
    want = {r.seq: r.p for r in df.select("seq", F.lag("org").over(w).alias("p")).collect()}
    assert got == want


def test_reorg_rule_ladder(spark):
    """The default thresholds (0.7, 20, 100, 0.5, 0.85), one literal reason per branch, at and below each threshold."""
    rows = [("Div A - History Dept", "Div A - History Department", 20, "name_change"),
            ("Div A - History Dept", "Div A - History Department", 19, ""),
            ("Alpha - One", "Omega - Two", 500, ""),
            ("College of Letters - Physics", "College of Science - Optics", 100, "mass_restructure"),
            ("College of Letters - Physics", "College of Science - Optics", 99, ""),
            ("North - Library Services", "Southwestern Extension - Library Services", 20, "division_rename"),
            ("North - Library Services", "Southwestern Extension - Library Services", 19, ""),
            ("North", "Southwestern Extension - Library Services", 60, "")]
    pairs = spark.createDataFrame([(*r[:3], i) for i, r in enumerate(rows)], "prev_org STRING, org STRING, transfer_count BIGINT, n INT")
    for similarity in (name_similarity, edit_similarity):
        got = {r.n: r for r in T.detect_reorganizations(pairs, PC, similarity=similarity).collect()}
        assert [got[i].reorg_reason for i in range(len(rows))] == [r[3] for r in rows], similarity
        assert all(got[i].is_reorg == bool(rows[i][3]) for i in range(len(rows)))
    assert {r.reorg_reason for r in T.detect_reorganizations(pairs, PC, T.ReorgRules(enabled=False)).collect()} == {""}


def test_peer_percentile_strictly_lower(spark):
    rows = [(i, f"p{i}", D1, "U", s) for i, s in enumerate([10.0, 20.0, 20.0, 30.0], 1)]
    df = spark.createDataFrame(rows, "seq BIGINT, id STRING, d DATE, org STRING, s DOUBLE")
    out = P.peer_percentiles(df, PC, {"department": lambda c: [c.org]})
    got = {r.id: r.salary_percentile for r in out.collect()}
    assert got == {"p1": 0.0, "p2": 25.0, "p3": 25.0, "p4": 75.0}


def test_entity_index_tie_options(spark):
    rows = [(1, "a", D1, 50.0), (2, "a", D2, 10.0), (3, "a", D2, 30.0)]
    df = spark.createDataFrame(rows, "seq BIGINT, id STRING, d DATE, s DOUBLE")
    assert entity_index(df, PC).collect()[0].s == 30.0
    assert entity_index(df, PC, tie="lowest").collect()[0].s == 10.0


def test_consecutive_pairs_skip_gaps(spark):
    rows = [(1, "a", D1, 1.0, 1.0), (2, "a", D3, 2.0, 1.0),      # absent from the middle snapshot
            (3, "b", D1, 1.0, 1.0), (4, "b", D2, 2.0, 1.0), (5, "b", D3, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "seq BIGINT, id STRING, d DATE, s DOUBLE, w DOUBLE")
    pairs = CH.consecutive_pairs(df, PC, ["s"]).collect()
    assert sorted((r.id, r.d_before, r.d_after) for r in pairs) == [("b", D1, D2), ("b", D2, D3)]


def test_fte_change_pivot_is_mean(spark):
    rows = [("g", dt.date(2025, 1, 1), 1.0), ("g", dt.date(2025, 6, 1), 3.0), ("g", dt.date(2024, 1, 1), 0.0)]
    df = spark.createDataFrame(rows, "g STRING, d DATE, f DOUBLE")
    c = CH.baseline_changes(df, ["g"], "d", "f")
    m = c.where(F.col("d") >= F.lit(dt.date(2025, 1, 1))).groupBy("g").agg(F.avg("fte_change").alias("m"))
    assert m.collect()[0].m == 2.0


def test_tolerance_match_one_to_one(spark):
    plan = spark.createDataFrame([(1, "D", "T", 100.0), (2, "D", "T", 100.0), (3, "D", "T", 100.0)],
                                 "line BIGINT, department STRING, title STRING, salary DOUBLE")
    recs = spark.createDataFrame([(10, "D", "T", 101.0), (11, "D", "T", 98.0), (12, "D", "T", 500.0)],
                                 "rid BIGINT, dept STRING, title STRING, s DOUBLE")
    out = {r.line: (r.record, r.status) for r in tolerance_match(plan, recs, "dept", "title", "s", "rid").collect()}
    assert out == {1: (10, "MATCH"), 2: (11, "MATCH"), 3: (None, "NO MATCH")}


def test_uniform_cut_without_protected_rows(spark):
    rows = [(1, "U1", "Staff", "x", 100.0), (2, "U1", "Staff", "x", 100.0), (3, "U2", "Faculty", "x", 300.0),
            (4, "U2", "Staff", "x", 100.0)]
    df = spark.createDataFrame(rows, "seq BIGINT, unit STRING, cat STRING, t STRING, s DOUBLE")
    cols = PanelCols(measure="s", category="cat", title="t", seq="seq")
    sc = S.Scenario(target_cost=78.0, overhead=0.3, unit="unit")
    out = {r.unit: r for r in S.uniform_cut(df, sc, cols).collect()}
    assert out["U1"].effective_pct == pytest.approx(out["U1"].uniform_pct)
    assert out["U2"].effective_pct == pytest.approx(out["U2"].uniform_pct * 4)


def test_take_until_matches_running_sum(spark):
    import random
    rnd = random.Random(1)
    rows = [(i, float(rnd.randrange(1000, 400000))) for i in range(2000)]
    df = spark.createDataFrame(rows, "seq BIGINT, s DOUBLE")
    target = 5_000_000.0
    got = sorted(r.seq for r in S.take_until(df, "s", target, "seq").collect())
    run, want = 0.0, []
    for seq, s in sorted(rows, key=lambda r: (-r[1], r[0])):
        if run >= target:
            break
        want.append(seq)
        run += s
    assert got == sorted(want)


def test_keyword_priority(spark):
    df = spark.createDataFrame([("Assistant Dean of Finance",), ("Accountant",), ("Gardener",), (None,)], "t STRING")
    table = [("Leadership", ["Dean"]), ("Finance", ["Finance", "Accountant"])]
    assert [r.c for r in df.select(keyword_category("t", table).alias("c")).collect()] == \
        ["Leadership", "Finance", "Other", "Other"]


@pytest.mark.parametrize("budget", [1, 1 << 20])
def test_exact_quantiles_match_numpy(spark, budget):
    import random

    import numpy as np

    from wavepanel.operators.aggregate import exact_quantiles
    rnd = random.Random(9)
    rows = [(g, float(rnd.randrange(0, 50))) for g in ("a", "b", "c") for _ in range(rnd.randrange(1, 40))]
    rows += [("one", 7.0), ("two", 1.0), ("two", 4.0), ("nulls", None), ("nulls", 3.0)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    qs = (0.1, 0.25, 0.5, 0.75, 0.9)
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", qs, budget=budget).collect()}
    for g in {r[0] for r in rows}:
        xs = [v for k, v in rows if k == g and v is not None]
        for q in qs:
            name = f"p{int(round(q * 100)):02d}"
            assert got[g][name] == pytest.approx(float(np.percentile(xs, q * 100)), rel=1e-12, abs=1e-12)


def test_linear_trend_matches_polyfit_and_guards(spark):
    import numpy as np

    from wavepanel.operators.aggregate import linear_trend
    rows = [("a", 1.0, 10.0), ("a", 2.0, 14.0), ("a", 4.0, 19.0), ("a", 7.0, 31.0),
            ("const", 3.0, 1.0), ("const", 3.0, 2.0), ("const", 3.0, 5.0),      # x does not vary
            ("two", 1.0, 1.0), ("two", 2.0, 2.0)]                                # fewer than 3 points
    df = spark.createDataFrame(rows, "g STRING, x DOUBLE, y DOUBLE")
    for method in ("two_pass", "builtin"):
        got = {r.g: r for r in linear_trend(df, "y", "x", ["g"], method=method).collect()}
        slope, intercept = np.polyfit([1, 2, 4, 7], [10, 14, 19, 31], 1)
        assert got["a"].slope == pytest.approx(slope) and got["a"].intercept == pytest.approx(intercept)
        assert got["const"].slope is None and got["two"].slope is None and got["two"].n == 2


def test_previous_unit_keeps_rows_without_keys(spark):
    df = spark.createDataFrame([(1, None, D1, "A"), (2, "a", D1, "A"), (3, "a", None, "B"), (4, None, None, "C")], "seq BIGINT, id STRING, d DATE, org STRING")
    out = {r.seq: (r.prev_org, r.dept_changed) for r in CH.previous_value(df, PC, "org").collect()}
    assert out == {1: (None, False), 2: (None, False), 3: ("A", True), 4: (None, False)}


def test_roster_growth_inside_the_division(spark):
    rows = [(1, "a", D1, "X", "X - 1", 100.0, dt.date(2020, 1, 1)), (2, "a", D2, "Y", "Y - 1", 200.0, dt.date(2020, 1, 1)),
            (3, "a", D3, "Y", "Y - 1", 220.0, dt.date(2020, 1, 1)), (4, "b", D3, "Y", "Y - 1", 50.0, None)]
    df = spark.createDataFrame(rows, "seq BIGINT, id STRING, d DATE, division STRING, org STRING, s DOUBLE, date_of_hire DATE")
    got = {r.id: r for r in P.department_roster(df, PC).collect()}
    assert (got["a"].growth_pct, got["a"].dollar_growth) == (pytest.approx(10.0), 20.0)
    assert got["a"].years_on_staff == pytest.approx((D3 - dt.date(2020, 1, 1)).days / 365.25) and got["b"].years_on_staff is None


def test_search_filters_cap_and_total(spark):
    rows = [(i, f"p{i}", "Ann" if i % 2 else "JoANNe", "Lee", "X" if i < 6 else "Y", "D", float(i)) for i in range(10)]
    idx = spark.createDataFrame(rows, "seq BIGINT, id STRING, first_name STRING, last_name STRING, division STRING, department STRING, s DOUBLE")
    got = P.search_entities(idx, first="ann", last="LE", division="X", cols=PC, limit=3).collect()
    assert [r.id for r in got] == ["p5", "p4", "p3"] and {r.total_matches for r in got} == {6}
    assert P.search_entities(idx, cols=PC).collect() == []


def test_composition_with_a_null_category(spark):
    rows = [(1, "Staff", 1.0, 10.0), (2, None, 1.0, 20.0), (3, "Faculty", 1.0, 30.0)]
    df = spark.createDataFrame(rows, "seq BIGINT, cat STRING, w DOUBLE, s DOUBLE").withColumn("t", F.lit("x"))
    cols = PanelCols(measure="s", category="cat", title="t", seq="seq", weight="w")
    got = sorted((r["class"], r.cat, r.level, r.headcount) for r in S.composition(df, S.Scenario(), cols).collect())
    assert got == [("All", "All", "grand_total", 2), ("Protected", "All", "subtotal", 1), ("Protected", "Faculty", "category", 1),
                   ("Unprotected", "All", "subtotal", 1), ("Unprotected", "Staff", "category", 1)]


def test_zero_sums_give_nulls(spark):
    df = spark.createDataFrame([(1, "U", "Staff", "x", 0.0, 1.0)], "seq BIGINT, unit STRING, cat STRING, t STRING, s DOUBLE, w DOUBLE")
    cols = PanelCols(measure="s", category="cat", title="t", seq="seq", weight="w")
    sc = S.Scenario(unit="unit")
    assert S.uniform_cut(df, sc, cols).collect()[0].required_cut is None
    assert S.management_protected(df, sc, cols).collect()[0].cut_amount is None
    from wavepanel.operators.cohort import price_factor
    idx = spark.createDataFrame([(D1, 1.0), (D2, 0.0)], "d DATE, v DOUBLE")
    assert price_factor(idx, D1, "d", "v").collect()[0][0] is None


def test_total_row_over_named_types(spark):
    from wavepanel.operators.aggregate import with_total_row
    cmp = spark.createDataFrame([("A", 10.0, 20.0, 10.0, 100.0), ("B", 10.0, 10.0, 0.0, 0.0), ("Other", 5.0, 50.0, 45.0, 900.0)],
                                "k STRING, f_start DOUBLE, f_end DOUBLE, f_change DOUBLE, f_pct_change DOUBLE")
    got = {r.k: (r.f_start, r.f_end, r.f_pct_change) for r in with_total_row(cmp, "k", ["f"], parts=["A", "B"]).collect()}
    assert got == {"A": (10.0, 20.0, 100.0), "B": (10.0, 10.0, 0.0), "TOTAL": (20.0, 30.0, 50.0)}


def test_rounding_of_large_sums_and_formats(spark):
    from wavepanel.functions.numeric import round_half_up
    from wavepanel.functions.present import signed_money
    r = spark.range(1).select(round_half_up(F.lit(3.2e15), 4).alias("a"), round_half_up(F.lit(1e16), 2).alias("b"),
                              round_half_up(F.lit(-2.675), 1).alias("c"), round_half_up(F.lit(None).cast("double")).alias("d"),
                              signed_money(F.lit(1234.4)).alias("e"), signed_money(F.lit(-1234.6)).alias("f")).first()
    assert tuple(r) == (3.2e15, 1e16, -2.7, None, "$+1,234", "$-1,235")


def test_quantiles_survive_outliers(spark):
    from wavepanel.operators.aggregate import exact_quantiles, exact_quantiles_of
    df = spark.range(20000).select(F.lit("g").alias("k"), (F.col("id") * 1.0).alias("v")).unionByName(
        spark.createDataFrame([("g", 1e12), ("g", float("nan")), ("g", None)], "k STRING, v DOUBLE"))
    for budget in (100, 1 << 20):
        assert exact_quantiles(df, ["k"], "v", (0.5, 0.995, 1.0), budget).first().asDict() == {"k": "g", "p50": 10000.0, "p99_5": 19900.0, "p100": 1e12}
    two = exact_quantiles_of(df.withColumn("w", -F.col("v")), ["k"], {"v": "a", "w": {0.5: "b", 0.0: "c"}}).first()
    assert (two.a, two.b, two.c) == (10000.0, -10000.0, -1e12)
    none = spark.createDataFrame([("n", None)], "k STRING, v DOUBLE")
    assert exact_quantiles(none, ["k"], "v").collect() == [] and exact_quantiles(none.limit(0), ["k"], "v").collect() == []


def test_one_group_of_a_million_values(spark):
    """Beyond the budget a group is ranked over range partitions: the exact quantiles, and no window of the whole group."""
    import numpy as np

    from wavepanel.operators import prefix
    from wavepanel.operators.aggregate import exact_quantiles, ranked_values
    n = 1_000_000
    df = spark.range(n).select(F.when(F.col("id") % 1000 == 0, F.lit("small")).otherwise(F.lit("hot")).alias("k"),
                               (F.pmod(F.col("id") * 7919, F.lit(n)) / 3.0).alias("v"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.k: r for r in exact_quantiles(df, ["k"], "v", (0.1, 0.5, 0.99), budget=1 << 16).collect()}
        ranked = ranked_values(df, ["k"], "v", budget=1 << 16)
        plan = spark._jvm.PythonSQLUtils.explainString(ranked._jdf.queryExecution(), "formatted")
        parts = prefix.ordered(df, [F.col("k"), F.col("v")]).groupBy(prefix.PART).count().agg(F.max("count").alias("m")).first()["m"]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    ids = np.arange(n)
    for k, own in (("small", ids % 1000 == 0), ("hot", ids % 1000 != 0)):
        v = (ids * 7919 % n)[own] / 3.0
        for q in (0.1, 0.5, 0.99):
            assert got[k][f"p{int(q * 100):02d}"] == pytest.approx(float(np.percentile(v, q * 100)), rel=1e-12)
    assert "SinglePartition" not in plan and "windowspecdefinition(__part" in plan and "windowspecdefinition(k" not in plan
    assert parts < n / 4


def test_plan_numbers_without_a_global_window(spark):
    import random
    rnd = random.Random(2)
    rows = [(i, rnd.choice([1, 2, 3]), rnd.choice([None, *[float(rnd.randrange(1, 60) * 250)] * 5])) for i in range(500)]
    df = spark.createDataFrame(rows, "_seq BIGINT, phase INT, salary DOUBLE")
    got = {r._seq: r.line for r in S.number_plan(df).collect()}
    want = sorted(rows, key=lambda r: (r[1], r[2] is None, -(r[2] or 0), r[0]))
    assert got == {r[0]: i for i, r in enumerate(want, 1)}


def test_take_until_edges(spark):
    df = spark.createDataFrame([(i, 100.0) for i in range(50)] + [(99, None)], "seq BIGINT, s DOUBLE")
    ids = lambda t: sorted(r.seq for r in S.take_until(df, "s", t, "seq").collect())
    assert ids(0.0) == [] and ids(250.0) == [0, 1, 2] and ids(300.0) == [0, 1, 2] and ids(1e9) == list(range(50))


def test_matching_with_many_equal_salaries(spark):
    plan = spark.createDataFrame([(i, "D", "T", 100.0) for i in range(1, 4)], "line BIGINT, department STRING, title STRING, salary DOUBLE")
    recs = spark.createDataFrame([(i, "D", "T", 100.0) for i in range(500)], "rid BIGINT, dept STRING, title STRING, s DOUBLE")
    out = {r.line: r.record for r in tolerance_match(plan, recs, "dept", "title", "s", "rid").collect()}
    assert out == {1: 0, 2: 1, 3: 2}


def test_missing_changes_are_neither_largest_nor_smallest(spark):
    from wavepanel.operators.aggregate import head_and_tail
    df = spark.createDataFrame([("a", None), ("b", 3.0), ("c", -1.0), ("d", None)], "k STRING, v DOUBLE")
    got = sorted((r.side, r.k) for r in head_and_tail(df, "v", ["k"], 3).collect())
    assert got == [("decrease", "b"), ("decrease", "c"), ("increase", "b"), ("increase", "c")]


def test_a_missing_salary_is_in_no_band(spark):
    df = spark.createDataFrame([(1, "boss", None, "Staff"), (2, "boss", 10.0, "Staff"), (3, "boss", 160_000.0, "Staff")], "seq BIGINT, t STRING, s DOUBLE, cat STRING")
    cols = PanelCols(measure="s", category="cat", title="t", seq="seq")
    got = {r.band: (r.headcount, r.total_salary) for r in S.salary_bands(df, S.Scenario(management_keywords=("boss",)), cols).collect()}
    assert got == {"<$75K": (1, 10.0), "$150K-$200K": (1, 160_000.0), "Total": (2, 160_010.0)}
