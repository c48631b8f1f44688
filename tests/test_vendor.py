"""Vendor files to tables and results to files, on small fixtures; calendar joins at their edges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandline.operators import folds, ingest, panel, schedule, validation
from strandline.sources import files, vendor


def day(text):
    return dt.date.fromisoformat(text)


def test_bars_factors_and_basics_of_all_years(spark, tmp_path):
    bars = spark.createDataFrame([("600000.SH", "20240102", 1.0, 2.0, 0.5, 1.5, 10.0, 3.0), ("000001.SZ", "20230103", 1.0, 2.0, 0.5, 1.5, 10.0, 3.0)], "ts_code string, trade_date string, open double, high double, low double, close double, vol double, amount double")
    for i, year in enumerate(("2024", "2023")):
        own = bars.where(F.col("trade_date").startswith(year))
        own.write.parquet(str(tmp_path / f"daily/{year}/x{i}.parquet"))
        own.select("ts_code", "trade_date", F.lit(2.0).alias("adj_factor")).union(own.select("ts_code", "trade_date", F.lit(2.0))).write.parquet(str(tmp_path / f"adj_factor/{year}/x{i}.parquet"))
        own.select("ts_code", "trade_date", F.lit(9.0).alias("pe")).write.parquet(str(tmp_path / f"daily_basic/{year}/x{i}.parquet"))
    got = sorted(map(tuple, vendor.read_bars(spark, str(tmp_path)).select("datetime", "instrument", "close", "volume", "money").collect()))
    assert got == [(day("2023-01-03"), "SZ000001", 1.5, 10.0, 3.0), (day("2024-01-02"), "SH600000", 1.5, 10.0, 3.0)]
    assert sorted(map(tuple, vendor.read_factors(spark, str(tmp_path)).collect())) == [(day("2023-01-03"), "SZ000001", 2.0), (day("2024-01-02"), "SH600000", 2.0)]
    basics = vendor.read_basics(spark, str(tmp_path)).collect()
    assert [(r.pe, r.pb) for r in basics] == [(9.0, None)] * 2


def test_panel_from_files_keeps_the_first_of_repeated_days(spark, tmp_path):
    bar = "ts_code string, trade_date string, open double, high double, low double, close double, vol double, amount double"
    def put(table, year, name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{table}/{year}/{name}.parquet"))

    put("daily", "2023", "a", [("600000.SH", "20230103", 1.0, 2.0, 0.5, 1.5, 10.0, 3.0), ("600000.SH", "20230103", 9.0, 9.0, 9.0, 9.0, 9.0, 9.0)], bar)
    put("daily", "2024", "a", [("600000.SH", "20240102", 1.0, 2.0, 0.5, 2.5, 20.0, 4.0), ("600000.SH", "20230103", 7.0, 7.0, 7.0, 7.0, 7.0, 7.0)], bar)
    put("adj_factor", "2023", "a", [("600000.SH", "20230103", 4.0), ("600000.SH", "20230103", 1.0)], "ts_code string, trade_date string, adj_factor double")
    put("daily_basic", "2023", "a", [("600000.SH", "20230103", None), ("600000.SH", "20230103", 5.0)], "ts_code string, trade_date string, pe double")
    bars, factors, basics = vendor.read_bars(spark, str(tmp_path)), vendor.read_factors(spark, str(tmp_path)), vendor.read_basics(spark, str(tmp_path))
    assert [r.adj_factor for r in factors.collect()] == [4.0] and [r.pe for r in basics.collect()] == [None]
    none = spark.createDataFrame([], "instrument string, delist_date date")
    got = ingest.build_panel(bars, factors, basics, none, ("pe",)).orderBy("datetime").collect()
    assert [(str(r.datetime), r.close, r.volume, r.money) for r in got] == [("2023-01-03", 6.0, 1000.0, 3000.0), ("2024-01-02", 10.0, 2000.0, 4000.0)]
    with pytest.raises(ValueError):
        ingest.build_panel(bars.drop("source_order"), factors, basics, none, ("pe",))


def test_lists_refuse_missing_columns_and_no_rows(spark, tmp_path):
    rows = spark.createDataFrame([("600000.SH", "n", "20000101", "20240105")], "ts_code string, name string, list_date string, delist_date string")
    rows.write.parquet(str(tmp_path / "gone"))
    assert [tuple(r) for r in vendor.read_listed(spark, str(tmp_path / "gone"), True).collect()] == [("SH600000", day("2000-01-01"), "n", day("2024-01-05"))]
    rows.drop("name").write.parquet(str(tmp_path / "short"))
    rows.limit(0).write.parquet(str(tmp_path / "empty"))
    for bad in ("short", "empty"):
        with pytest.raises(ValueError):
            vendor.read_listed(spark, str(tmp_path / bad), True)


def test_snapshots_names_and_statements(spark, tmp_path):
    spark.createDataFrame([("000300.SH", "600000.SH", "20240131")], "index_code string, con_code string, trade_date string").write.parquet(str(tmp_path / "w"))
    assert [tuple(r) for r in vendor.read_index_weights(spark, str(tmp_path / "w")).collect()] == [("000300.SH", day("2024-01-31"), "SH600000")]
    spark.createDataFrame([("600000.SH", "ST x", "20240101", None, "20231230")], "ts_code string, name string, start_date string, end_date string, ann_date string").write.parquet(str(tmp_path / "n"))
    assert [tuple(r) for r in vendor.read_names(spark, str(tmp_path / "n")).collect()] == [("SH600000", "ST x", day("2024-01-01"), None, day("2023-12-30"))]
    rows = spark.createDataFrame([("income", "600000.SH", "20231231", 1.0), ("cashflow", "600000.SH", "20231231", 2.0)], "endpoint string, ts_code string, end_date string, x double")
    vendor.write_statements(rows, str(tmp_path / "s"))
    assert [r.x for r in vendor.read_statements(spark, str(tmp_path / "s"), "cashflow").collect()] == [2.0]


def snapshots(spark, path, rows):
    spark.createDataFrame(rows, "index_code string, con_code string, trade_date string").write.parquet(path, mode="overwrite")
    return path


def test_membership_from_files_to_spans_and_stamps(spark, tmp_path):
    target, path = str(tmp_path / "out"), str(tmp_path / "w")
    months = ["20240131", "20240229", "20240329"]
    rows = [("A.SH", "600000.SH", m) for m in months] + [("A.SH", "000001.SZ", months[0]), ("A.SH", "000001.SZ", months[2]), ("B.SH", "600000.SH", months[0])]
    got = {r.index_code: tuple(r)[1:] for r in vendor.resolve_membership(spark, snapshots(spark, path, rows), target).collect()}
    assert got == {"A.SH": (3, 2, day("2024-01-31"), day("2024-03-29")), "B.SH": (1, 1, day("2024-01-31"), day("2024-01-31"))}
    spans = files.read_spans(spark, f"{target}/spans/index_code=A.SH")
    assert sorted(map(tuple, spans.collect())) == [("SH600000", day("2024-01-31"), day("2099-12-31")), ("SZ000001", day("2024-01-31"), day("2024-01-31")), ("SZ000001", day("2024-03-29"), day("2099-12-31"))]
    assert sorted(map(tuple, vendor.read_coverage(spark, target).collect())) == [("A.SH", day("2024-03-29")), ("B.SH", day("2024-01-31"))]

    # One index anew: the other's files and stamp stay. An entry that is no day is left out until its index is resolved again.
    later = snapshots(spark, str(tmp_path / "w2"), rows + [("B.SH", "000001.SZ", "20240430")])
    assert [r.index_code for r in vendor.resolve_membership(spark, later, target, ["B.SH"]).collect()] == ["B.SH"]
    assert sorted(map(tuple, vendor.read_coverage(spark, target).collect())) == [("A.SH", day("2024-03-29")), ("B.SH", day("2024-04-30"))]
    assert files.read_spans(spark, f"{target}/spans/index_code=A.SH").count() == 3
    spark.createDataFrame([("A.SH", "soon")], "index_code string, last_snapshot string").write.partitionBy("index_code").option("partitionOverwriteMode", "dynamic").json(f"{target}/coverage", mode="overwrite")
    assert [r.index_code for r in vendor.read_coverage(spark, target).collect()] == ["B.SH"]
    with pytest.raises(ValueError):
        vendor.resolve_membership(spark, path, target, ["C.SH"])


def test_known_cases_of_membership(spark, tmp_path):
    schema = "index_code string, instrument string, action string, day date"
    spans = spark.createDataFrame([("A", "x", day("2024-01-31"), day("2024-02-29")), ("A", "x", day("2024-04-30"), day("2099-12-31")), ("A", "y", day("2024-01-31"), day("2099-12-31"))], "index_code string, instrument string, start date, end date")
    cases = [("x", "enter", "2024-04-20", "match"), ("x", "leave", "2024-02-20", "match"), ("x", "leave", "2024-08-20", "too far"), ("y", "leave", "2024-02-20", "still a member"), ("z", "enter", "2024-02-20", "no run"), ("z", "join", "2024-02-20", "no run"), ("x", "join", "2024-02-20", "unknown action"), ("x", None, "2024-02-20", "unknown action")]
    table = spark.createDataFrame([("A", i, a, day(d)) for i, a, d, _ in cases] * 2, schema)
    got = {(r.instrument, r.action, str(r.day)): r.verdict for r in validation.membership_cases(spans, table, 15).collect()}
    assert got == {(i, a, d): v for i, a, d, v in cases}
    # Equally near edges: the earlier. No day and no index: no match.
    odd = validation.membership_cases(spans, spark.createDataFrame([("A", "x", "enter", day("2024-03-16")), ("A", "x", "enter", None), (None, "x", "enter", day("2024-04-30"))], schema), 50).collect()
    assert {(r.index_code, r.day): (r.nearest, r.verdict) for r in odd} == {("A", day("2024-03-16")): (day("2024-01-31"), "match"), ("A", None): (day("2024-01-31"), "too far"), (None, day("2024-04-30")): (None, "no run")}
    assert validation.membership_cases(spans, table.limit(0), 15).count() == 0

    path = snapshots(spark, str(tmp_path / "w"), [("A", "600000.SH", "20240131"), ("A", "000001.SZ", "20240131"), ("A", "000001.SZ", "20240229")])
    fine = spark.createDataFrame([("A", "SH600000", "leave", day("2024-02-05"))], schema)
    assert vendor.resolve_membership(spark, path, str(tmp_path / "out"), cases=fine).count() == 1
    with pytest.raises(ValueError, match="known case"):
        vendor.resolve_membership(spark, path, str(tmp_path / "none"), cases=fine.withColumn("action", F.lit("enter")).withColumn("day", F.lit("2020-01-01").cast("date")))
    assert not (tmp_path / "none").exists()


def test_artifact_and_benchmark_summaries(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Trade_Date ,code\n2024-01-02,A\n2024-01-02,B\n2024-01-05,A\nsoon,A\n,\n")
    got = vendor.artifact_summary(vendor.read_table(spark, str(tmp_path / "a.csv")), "trade_date", "2024-01-03").first()
    assert tuple(got) == (4, day("2024-01-02"), day("2024-01-05"), 2, True)
    (tmp_path / "r.csv").write_text("effective_start,effective_end\n2024-01-02,2024-02-01\n2023-01-02,2024-01-01\n")
    got = vendor.artifact_summary(vendor.read_table(spark, str(tmp_path / "r.csv")), "range").first()
    assert tuple(got) == (2, day("2023-01-02"), day("2024-02-01"), 0, False)
    (tmp_path / "b.csv").write_text("date,close\n2024-01-02,1.5\n2024-01-03,nan\n2024-01-04,\n2024-01-05,2\n")
    got = vendor.benchmark_summary(vendor.read_table(spark, str(tmp_path / "b.csv")), "2024-01-05").first()
    assert tuple(got) == (4, day("2024-01-02"), day("2024-01-05"), 0.5, False)


def test_sinks(spark, tmp_path):
    registry = spark.createDataFrame([("A", day("2024-01-05"), "other", None)], "instrument string, delist_date date, reason string, defect string")
    vendor.write_registry(registry, str(tmp_path / "reg"))
    assert spark.read.parquet(str(tmp_path / "reg")).count() == 1
    with pytest.raises(ValueError):
        vendor.write_registry(registry.withColumn("defect", F.lit("no date")), str(tmp_path / "reg"))
    rows = spark.createDataFrame([("2024-01-02", "A"), ("2024-01-03", "A")], "trade_date string, code string")
    vendor.write_artifact(rows, str(tmp_path / "art"), "2024-01-03")
    assert spark.read.json(str(tmp_path / "art/manifest")).select("n_rows", "first", "last").first() == (2, "2024-01-02", "2024-01-03")
    with pytest.raises(ValueError):
        vendor.write_artifact(rows, str(tmp_path / "art"), "2024-01-02")
    vendor.write_artifact(rows.withColumnRenamed("trade_date", "date"), str(tmp_path / "bench"), "2024-01-03", day="date")
    assert vendor.benchmark_summary(vendor.read_table(spark, str(tmp_path / "bench/rows")).withColumnRenamed("code", "close")).first()["rows"] == 2
    vendor.write_run(str(tmp_path / "run"), nav=rows, trades=rows.limit(0))
    assert spark.read.parquet(str(tmp_path / "run/trades")).columns == rows.columns
    picks = spark.createDataFrame([("2024-01-02", "2024-01-03", 1, "A", "a", 0.5, True, None)], "as_of_date string, entry_date string, rank int, stock_code string, stock_name string, predicted_score double, tradable_flag boolean, unavailable_reason string")
    for at in ("2024-01-02", "2024-01-03", "2024-01-03"):
        own = picks.withColumn("as_of_date", F.lit(at))
        vendor.write_recommendations(own, own, str(tmp_path / "rec"))
    assert spark.read.json(str(tmp_path / "rec/list_json")).count() == 2
    vendor.write_risk_audit(rows.select(F.col("trade_date").alias("date"), F.col("code").alias("instrument"), F.col("code").alias("ts_code"), F.lit("ST").alias("name")), str(tmp_path / "st"))
    assert spark.read.csv(str(tmp_path / "st"), header=True).columns == ["date", "instrument", "ts_code", "name"]


def test_pool_there_and_back(spark, tmp_path):
    metrics = spark.createDataFrame([("h1", 0.1), ("h2", 0.2)], "expr_hash string, fitness double")
    exprs = spark.createDataFrame([("h1", "ts_mean(close, 5)"), ("h2", "close")], "expr_hash string, expr string")
    vendor.write_pool(metrics, exprs, str(tmp_path / "p"))
    assert sorted((r.expr_hash, r.expr, r.orientation) for r in vendor.read_pool(spark, str(tmp_path / "p")).collect()) == [("h1", "ts_mean(close, 5)", 1), ("h2", "close", 1)]
    vendor.write_pool(metrics, exprs.limit(1), str(tmp_path / "p"))
    with pytest.raises(ValueError):
        vendor.read_pool(spark, str(tmp_path / "p"))


def test_sleeves(spark, tmp_path):
    (tmp_path / "a.txt").write_text("A\t2020-01-01\t2099-12-31\n")
    (tmp_path / "b.txt").write_text("B\t2020-01-01\t2099-12-31\nA\t2018-01-01\t2019-12-31\n")
    spans = vendor.read_sleeves(spark, {"large": str(tmp_path / "a.txt"), "small": str(tmp_path / "b.txt")})
    coverage = spark.createDataFrame([("large", day("2024-01-31")), ("small", day("2024-01-31"))], "sleeve string, covered_to date")
    assert sorted(map(tuple, vendor.sleeve_map(spans, coverage, "2024-01-05").collect())) == [("A", "large"), ("B", "small")]
    for at in ("2024-02-01", "2019-06-30"):
        with pytest.raises(ValueError):
            vendor.sleeve_map(spans, coverage, at)
    with pytest.raises(ValueError):
        vendor.sleeve_map(spans.union(spark.createDataFrame([("small", "A", day("2021-01-01"), day("2099-12-31"))], spans.schema)), coverage, "2024-01-05")


def test_calendar_joins_at_their_edges(spark):
    days = panel.calendar(spark.createDataFrame([(day(d),) for d in ("2024-01-02", "2024-01-03", "2024-01-08")], "datetime date"))
    dates = spark.createDataFrame([(None,), *((day(d),) for d in ("2000-01-01", "2024-01-01", "2024-01-02", "2024-01-04", "2024-01-08", "2024-02-01"))], "d date")
    assert {str(r.d): str(r.next) for r in panel.next_day(dates, days).collect()} == {"None": "None", "2000-01-01": "2024-01-02", "2024-01-01": "2024-01-02", "2024-01-02": "2024-01-03", "2024-01-04": "2024-01-08", "2024-01-08": "None", "2024-02-01": "None"}
    assert {str(r.d): str(r.due) for r in folds.next_of(dates, days).collect()} == {"None": "None", "2000-01-01": "2024-01-02", "2024-01-01": "2024-01-02", "2024-01-02": "2024-01-02", "2024-01-04": "2024-01-08", "2024-01-08": "2024-01-08", "2024-02-01": "None"}
    spans = spark.createDataFrame([(i, day(a), day(b)) for i, a, b in ((0, "1990-01-01", "2099-12-31"), (1, "2024-01-03", "2024-01-03"), (2, "2024-01-04", "2024-01-07"), (3, "2024-01-09", "2025-01-01"), (4, "2024-01-08", "2024-01-02"), (5, "1990-01-01", "1991-01-01"))], "id int, a date, b date")
    assert {r.id: r.n_days for r in schedule.days_between(days, "a", "b", spans).collect()} == {0: 3, 1: 1, 2: 0, 3: 0, 4: 0, 5: 0}
    empty = days.limit(0)
    assert {r.next for r in panel.next_day(dates, empty).collect()} == {None}
    assert {r.n_days for r in schedule.days_between(empty, "a", "b", spans).collect()} == {0}
    members = spans.select(F.col("id").cast("string").alias("instrument"), F.col("a").alias("start"), F.col("b").alias("end"))
    assert sorted((r.instrument, str(r.datetime)) for r in panel.members_at(days, members).collect()) == [("0", "2024-01-02"), ("0", "2024-01-03"), ("0", "2024-01-08"), ("1", "2024-01-03")]
