import json

import pandas as pd
from pyspark.sql import functions as F

from gapline.plans import catalogue, jobs
from gapline.sources import landed, sinks

FOLDER = "/root/testdata/sf0.001"


def test_document_round_trip(spark, tmp_path):
    document = catalogue.json_document(spark, FOLDER)
    sinks.write_json(document, str(tmp_path / "doc"))
    text = next((tmp_path / "doc").glob("part-*.txt")).read_text()
    assert [r["label"] for r in json.loads(text)["funnel"]] == ["all", "+ finished", "+ urgent", "+ large"]
    schema = "edu_total array<struct<category:string,n:long,pct:double>>, funnel array<struct<label:string,n:long,pct:double>>, quality struct<min_sample:int,low_groups:string>"
    doc = landed.document(spark, str(tmp_path / "doc"), schema)
    again = landed.result_set(doc, "edu_total").toPandas()
    wanted = catalogue.edu_total_distribution(spark, FOLDER).toPandas()
    assert sorted(again.itertuples(index=False, name=None)) == sorted(wanted.itertuples(index=False, name=None))
    assert again["pct"].is_monotonic_decreasing
    maps = spark.createDataFrame([({"a": 1.0, "b": 2.0},)], "m map<string,double>")
    assert {tuple(r) for r in landed.result_set(maps, "m").collect()} == {("a", 1.0), ("b", 2.0)}


def test_stata_files(spark, tmp_path):
    for year in (2016, 2017):
        pd.DataFrame({"who": ["a", "b"], "income": [1.5, None], "year": [year, year]}).to_stata(tmp_path / f"{year}.dta", write_index=False)
    spark.dataSource.register(landed.StataSource)
    read = lambda y: spark.read.format("stata").schema("who string, income double, year long").load(str(tmp_path / f"{y}.dta"))
    pooled = landed.combined({"2016": read(2016), "2017": read(2017)}, "cohort")
    assert sorted((r["who"], r["income"] or 0, r["year"], r["cohort"]) for r in pooled.collect()) == [("a", 1.5, 2016, "2016"), ("a", 1.5, 2017, "2017"), ("b", 0, 2016, "2016"), ("b", 0, 2017, "2017")]


def test_csv_and_evidence(spark, tmp_path):
    df = spark.createDataFrame([("가·나", 1)], "field string, graduates long")
    for _ in range(2):  # reruns replace
        sinks.write_csv(df, str(tmp_path / "csv"))
        sinks.write_evidence({"grad": df}, str(tmp_path / "evidence"))
    assert landed.statistics(spark, str(tmp_path / "csv"), "field string, graduates long").collect() == df.collect()
    assert spark.read.parquet(str(tmp_path / "evidence/grad")).count() == 1


def test_union_fills_missing_columns_and_licences_exclude(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, t string"), spark.createDataFrame([(2,)], "id int")
    both = landed.combined({"one": a, "two": b}, "site")
    assert {(r["id"], r["t"], r["site"]) for r in both.collect()} == {(1, "x", "one"), (2, None, "two")}
    assert landed.without_sources(both, spark.createDataFrame([("two",)], "site string"), "site").count() == 1
    months = spark.sql("SELECT date'2025-08-31' AS m UNION ALL SELECT date'2026-08-01'").transform(lambda x: landed.months(x, "m", "2025-08-01", "2026-07-01"))
    assert months.agg(F.count("*")).first()[0] == 1


def test_landed_files_have_their_schemas(spark, tmp_path):
    for site, more in (("one", '"title": "a", "start_date": "2026-09-01"'), ("two", '"company": "b"')):
        (tmp_path / site).write_text('{"posting_id": "%s", %s}\n' % (site, more))
    got = landed.postings(spark, {site: str(tmp_path / site) for site in ("one", "two")})
    assert set(got.columns) == {c.split()[0] for c in landed.POSTINGS.split(", ")}
    assert {(r["posting_id"], r["site"], r["title"], str(r["start_date"])) for r in got.collect()} == {("one", "one", "a", "2026-09-01"), ("two", "two", None, "None")}
    (tmp_path / "codes.csv").write_text("code6,name,major\n012345,x,y\n")
    assert landed.code_master(spark, str(tmp_path / "codes.csv")).first()["code6"] == "012345"
    for read, text, total in ((landed.graduates, "field,graduates,year\na,3,2024\nb,4,2024\n", ("graduates", 7)), (landed.population, "district,subdistrict,age_band,people\na,b,20,1.5\n", ("people", 1.5)), (landed.policies, "project,budget\np,2.5\nq,1\n", ("budget", 3.5))):
        (tmp_path / "s.csv").write_text(text)
        assert read(spark, str(tmp_path / "s.csv")).agg(F.sum(total[0])).first()[0] == total[1]


def test_whole_run_writes_a_table_a_stage(spark, tmp_path):
    df = spark.createDataFrame([(1, "Good  Post", "a"), (2, "good post", "a"), (3, " ", "a"), (4, None, "b"), (5, "other thing", "b")], "id int, t string, region string")
    rules = jobs.Rules("t", ["clean"], [F.col("id")], F.col("region") == "a", {"good post": "100001"})
    for _ in range(2):  # reruns replace
        got = {r["stage"]: r["n"] for r in jobs.prepare(df, rules, str(tmp_path)).collect()}
    assert got == {"collected": 5, "normalised": 3, "merged": 2, "region": 1, "classified": 1}
    assert spark.read.parquet(f"{tmp_path}/rejected").count() == 2
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/classified").select("id", "code", "confidence").collect()] == [(1, "100001", "high")]


def test_whole_run_keeps_small_tables(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i % 3} " * 20, "a") for i in range(30)], "id int, t string, region string")
    setting = spark.conf.get(jobs.CLEANUP)
    jobs.prepare(df, jobs.Rules("t", ["clean"], [F.col("id")], F.lit(True)), str(tmp_path))
    for stage in ("normalised", "merged", "region", "classified"):
        assert list((tmp_path / stage).glob("*.zstd.parquet")) == list((tmp_path / stage).glob("*.parquet")) != []
    assert spark.conf.get(jobs.CLEANUP) == setting
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/merged").collect()) == [0, 1, 2]
