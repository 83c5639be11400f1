import pytest
from pyspark.sql import functions as F

from gapline.operators import cleaning, gaps, governance, quality, rates, shares


def one(df):
    return [tuple(r) for r in df.collect()]


def test_funnel_is_in_percent_of_the_first_step(spark):
    df = spark.range(25135).select((F.col("id") < 2315).alias("a"), (F.col("id") < 1070).alias("b"), (F.col("id") < 816).alias("c"))
    got = one(shares.funnel(df, [("all", F.lit(True)), ("a", F.col("a")), ("b", F.col("b")), ("c", F.col("c"))]))
    assert [(n, p) for _, _, n, p in got] == [(25135, 100.0), (2315, 9.2), (1070, 4.3), (816, 3.2)]


def test_funnel_of_nothing_and_of_nulls(spark):
    empty = spark.createDataFrame([], "x boolean")
    assert one(shares.funnel(empty, [("all", F.lit(True)), ("x", F.col("x"))])) == [(0, "all", 0, None), (1, "x", 0, None)]
    nulls = spark.createDataFrame([(None,), (True,)], "x boolean")
    assert one(shares.funnel(nulls, [("all", F.lit(True)), ("x", F.col("x"))]))[1] == (1, "x", 1, 50.0)


def test_shares_leave_out_the_unclassified(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] + [(None,)] * 6, "g string")
    got = {r["g"]: r["share"] for r in shares.classified_shares(df, "g", "share", F.col("g").isNull()).collect()}
    assert got == {"a": 75.0, "b": 25.0}


def test_difference_is_rounded_after_subtraction_and_keeps_both_sides(spark):
    left = spark.createDataFrame([("x", 18.87, 1), ("only left", 1.0, 1)], "k string, share double, n long")
    right = spark.createDataFrame([("x", 9.04, 2162), ("only right", 2.0, 99)], "k string, share double, n long")
    got = {r["k"]: r for r in shares.share_difference(left, right, "k").collect()}
    assert (got["x"]["left_share"], got["x"]["right_share"], got["x"]["diff_pp"]) == (18.9, 9.0, 9.8)
    assert got["only left"]["n_right"] is None and got["only left"]["low_sample"] is None
    assert got["only right"]["diff_pp"] == -2.0 and got["only right"]["low_sample"] is True


@pytest.mark.parametrize("n, low", [(99, True), (100, False), (101, False)])
def test_low_sample_is_strict(spark, n, low):
    df = spark.range(n).select(F.lit("g").alias("g"))
    assert shares.crosstab(df, "g", {"all": F.lit(True)}).first()["low_sample"] is low


def test_rates_without_people_or_group(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "k string, n long")
    people = spark.createDataFrame([("a", 1000), ("b", 0)], "k string, people long")
    assert {r["k"]: r["rate"] for r in rates.rate_per_people(counts, people, "k").collect()} == {"a": 50.0, "b": None, "c": None}
    df = spark.createDataFrame([(None, True), ("x", False)], "g string, y boolean")
    assert {r["g"] for r in rates.conditional_rates(df, "g", {"y": F.col("y")}).collect()} == {"(unknown)", "x"}


def test_exit_rows_without_count_stay(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "f string")
    counts = spark.createDataFrame([("a", 7), ("c", 151)], "f string, n long")
    assert {tuple(r) for r in rates.with_totals(rows, counts, "f", "graduates").collect()} == {("a", 7), ("b", None)}


def test_welch_with_one_row_is_not_significant(spark):
    df = spark.createDataFrame([("g", True, 5.0), ("g", False, 1.0), ("g", False, 2.0)], "g string, l boolean, v double")
    got = gaps.welch_gap(df, ["g"], F.col("l"), F.col("v")).first()
    assert got["gap"] == 3.5 and got["t_stat"] is None and got["significant"] is False


def test_segment_net_and_retained(spark):
    rows = [("stay", 203.1, 37.7), ("capital", 243.4, 43.5), ("other", 240.7, 32.4)]
    df = spark.createDataFrame(rows, "s string, i double, c double")
    assert {r["s"]: r["net"] for r in gaps.segment_stats(df, "s", F.col("i"), F.col("c")).collect()} == {"stay": 165.4, "capital": 199.9, "other": 208.3}
    assert {r["s"]: r["retained_pct"] for r in gaps.retained_gap(df, "s", "stay", F.col("i"), F.col("c")).collect()}["capital"] == 85.6


def test_sensitivity_does_not_depend_on_order(spark):
    df = spark.range(1000).select((F.col("id") % 2 == 0).alias("l"), F.when(F.col("id") == 0, 1e6).otherwise(F.col("id").cast("double")).alias("v"))
    a = one(gaps.outlier_sensitivity(df, F.col("l"), F.col("v")))
    b = one(gaps.outlier_sensitivity(df.orderBy(F.desc("id")), F.col("l"), F.col("v")))
    assert a == b and [r[0] for r in a] == ["raw", "trimmed", "clipped", "iqr", "median"]


def test_latest_breaks_ties_and_merges(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "b", 1)], "id int, k string, t int")
    assert {r["id"] for r in cleaning.latest(df, ["k"], [-F.col("t"), F.col("id")]).collect()} == {1, 3}
    assert cleaning.merge_items(df, ["k"], n=F.count("*")).count() == 2


def test_join_by_code_reports_what_a_name_join_would_hide(spark):
    postings = spark.createDataFrame([("100001", "education, law, army"), ("999999", "lost")], "code6 string, label string")
    master = spark.createDataFrame([("100001", "education, law", "m1")], "code6 string, name string, major string")
    joined = {r["code6"]: r["major"] for r in cleaning.lookup(postings, master, "code6").collect()}
    assert joined == {"100001": "m1", "999999": None}
    assert [r["code6"] for r in cleaning.unmatched(postings, master, "code6").collect()] == ["999999"]


def test_classify_and_reasons(spark):
    df = spark.createDataFrame([("nurse",), ("night nurse",), ("",), (None,), ("x",)], "t string")
    got = [(r["code"], r["confidence"], r["reason"]) for r in cleaning.classify(df, F.col("t"), {"nurse": "1"}, [("nurse", "2")]).collect()]
    assert got == [("1", "high", None), ("2", "medium", None), (None, "none", "no text"), (None, "none", "no text"), (None, "none", "no rule")]


def test_normalise_keeps_rows_with_a_reason(spark):
    df = spark.createDataFrame([("  A  b ",), (" ",), (None,)], "t string")
    assert [(r["clean"], r["reason"]) for r in cleaning.normalise(df, "t").collect()] == [("a b", None), (None, "blank"), (None, "missing")]


def test_as_of_includes_both_ends_and_open_ends(spark):
    df = spark.sql("SELECT * FROM VALUES (1, date'2026-09-07', date'2026-09-07'), (2, date'2026-09-01', null), (3, date'2026-09-08', null), (4, date'2026-01-01', date'2026-09-06') t(id, a, b)")
    assert {r["id"] for r in cleaning.as_of(df, "a", "b", "2026-09-07").collect()} == {1, 2}


def test_comparisons_are_governed(spark):
    df = spark.createDataFrame([("a", 2.0)], "k string, v double")
    flow, stock = governance.Measure(df, "k", "v", "count", "flow", "code"), governance.Measure(df, "k", "v", "count", "stock", "code")
    with pytest.raises(ValueError, match="flow"):
        governance.compare(flow, stock)
    with pytest.raises(ValueError, match="code"):
        governance.compare(governance.Measure(df, "k", "v", "percent", "flow", "name"), flow)
    assert governance.compare(flow, flow).first()["diff_pp"] == 0.0
    registered = governance.register(spark, [("ok", 1.0, 1, 1, "all", True, ""), ("bad", 1.0, 1, 1, "part", False, "basis")])
    results = spark.createDataFrame([("ok",), ("bad",), ("new",)], "metric string")
    assert {r["metric"] for r in governance.forbidden(results, registered).collect()} == {"bad", "new"}
    assert governance.usable(registered).count() == 1


def test_two_denominators_and_stages(spark):
    df = spark.createDataFrame([("g", 1), ("g", 0), ("g", None), ("g", None)], "g string, y int")
    got = quality.two_denominators(df, "g", F.col("y") == 1, F.col("y").isNotNull()).first()
    assert (got["rate_all"], got["rate_stated"]) == (25.0, 50.0)
    assert one(quality.stage_counts(df, [("all", F.lit(True)), ("stated", F.col("y").isNotNull())])) == [(0, "all", 4), (1, "stated", 2)]


def test_comparisons_round_last_and_fill_shares_only(spark):
    a = spark.createDataFrame([("x", 18.94), ("y", 1.0)], "k string, v double")
    b = spark.createDataFrame([("x", 9.06)], "k string, v double")
    of = lambda df, unit: governance.Measure(df, "k", "v", unit, "flow", "code")
    assert {r["key"]: r["diff_pp"] for r in governance.compare(of(a, "percent"), of(b, "percent")).collect()} == {"x": 9.9, "y": 1.0}
    assert {r["key"]: r["diff_pp"] for r in governance.compare(of(a, "value"), of(b, "value")).collect()} == {"x": 9.9, "y": None}


def test_classes_and_districts_keep_every_row(spark):
    df = spark.createDataFrame([("부산 강서구 1",), ("x",), (None,)], "address string")
    known = spark.createDataFrame([("강서구",), ("강서구",)], "district string")
    got = cleaning.validated(df, F.regexp_extract("address", "(\\S+구)", 1), known, "district").collect()
    assert sorted(r["district"] for r in got) == ["(unknown)", "(unknown)", "강서구"]
    classes = df.select(cleaning.first_class(F.col("address"), [("부산", "a"), ("구", "b")], "none").alias("c")).collect()
    assert [r["c"] for r in classes] == ["a", "none", "none"]


def test_reason_needs_only_the_beginning_of_long_texts(spark, monkeypatch):
    texts = [None, "", " " * 40, " " * 70 + "b", " " * 70 + "x" * 20, "a" * 19 + " " * 40, "\u03a3\u0130" * 8 + " a", "A  b\n" * 500, "\u0130" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = [(r["id"], r["clean"], r["reason"]) for r in cleaning.normalise(df, "t", 20).orderBy("id").collect()]
    assert [r[2] for r in rows] == ["missing", "blank", "blank", "short", None, "short", None, None, None]
    assert rows[7][1] == ("a b " * 500).strip() and rows[4][1] == "x" * 20
    whole = cleaning.clean_text
    monkeypatch.setattr(cleaning, "clean_text", lambda v: F.when(F.length(v) > 1000, F.raise_error(F.lit("cleaned whole"))).otherwise(whole(v)))
    rejected = cleaning.normalise(df, "t", 20).filter("reason is not null").drop("clean")
    assert [r["id"] for r in rejected.orderBy("id").collect()] == [0, 1, 2, 3, 5]


def test_latest_carries_keys_once(spark):
    df = spark.createDataFrame([(i, f"k{i % 2}", 0.0 if i < 2 else -0.0, f"v{i}") for i in range(6)], "id long, long_key string, number double, v string")
    got = cleaning.latest(df, ["long_key", "number"], [-F.col("id")])
    assert got.columns == df.columns and got.schema.simpleString() == df.schema.simpleString()
    assert sorted((r["id"], r["long_key"], str(r["number"]), r["v"]) for r in got.collect()) == [(4, "k0", "-0.0", "v4"), (5, "k1", "-0.0", "v5")]
    carried = got._jdf.queryExecution().optimizedPlan().toString().split("min_by(")[1].split(" AS _row")[0]
    assert "number" in carried and "long_key" not in carried
