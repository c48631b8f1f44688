"""Files there and back, refusals, and streams against their batch twins."""

import json

import datetime

import pytest
from pyspark.sql import functions as F

from strandline.functions import codes
from strandline.operators import panel as panels
from strandline.plans import catalog
from strandline.sources import files
from strandline.streaming import streams


def drained(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def test_days_refuse_what_is_no_day(spark, tmp_path):
    (tmp_path / "d.txt").write_text("2024-01-03\n\n2024-01-02\n2024-01-03\n")
    assert [(str(r.datetime), r.idx) for r in files.read_days(spark, str(tmp_path / "d.txt")).orderBy("idx").collect()] == [("2024-01-02", 0), ("2024-01-03", 1)]
    (tmp_path / "e.txt").write_text("2024-01-03\nsoon\n")
    with pytest.raises(ValueError):
        files.read_days(spark, str(tmp_path / "e.txt"))


def test_spans_there_and_back(spark, tmp_path, sf_dir):
    spans = catalog.all_queries()["membership_runs"](spark, sf_dir)
    files.write_spans(spans, str(tmp_path / "s"))
    assert sorted(map(tuple, files.read_spans(spark, str(tmp_path / "s")).collect())) == sorted(map(tuple, spans.collect()))


def test_positions_there_and_back(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-02", "A", 0.5), ("2024-01-02", "B", 0.25), ("2024-01-03", "A", 1.0)], "d string, instrument string, weight double").select(F.to_date("d").alias("datetime"), "instrument", "weight")
    (tmp_path / "p").mkdir()
    (tmp_path / "p/x.json").write_text(json.dumps({"2024-01-02": {"A": 0.5, "B": 0.25}, "2024-01-03": {"A": 1.0, "C": None}}))
    assert sorted(map(tuple, files.read_positions(spark, str(tmp_path / "p")).collect())) == sorted(map(tuple, rows.collect()))
    files.write_positions(rows, str(tmp_path / "q"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "q")).collect()) == ['{"2024-01-02":{"A":0.5,"B":0.25}}', '{"2024-01-03":{"A":1.0}}']


def test_fold_reports(spark, tmp_path):
    def report(k, days):
        values = {d: 0.01 * k for d in days}
        return json.dumps({"schema_version": "1", "fold_index": k, "daily_series": {"excess_return": values, "components": {"return": values, "bench": {}, "cost": {}}, "ic": {"1": values}}}, indent=1)

    (tmp_path / "a.json").write_text(report(1, ["2024-01-02", "2024-01-03"]))
    (tmp_path / "b.json").write_text(report(2, ["2024-01-04"]))
    got = files.read_fold_reports(spark, str(tmp_path))
    assert sorted((r.fold, str(r.datetime), r.excess, r.gross, r.ic) for r in got.collect()) == [(1, "2024-01-02", 0.01, 0.01, 0.01), (1, "2024-01-03", 0.01, 0.01, 0.01), (2, "2024-01-04", 0.02, 0.02, 0.02)]
    (tmp_path / "c.json").write_text(report(3, ["2024-01-04"]))
    with pytest.raises(ValueError):
        files.read_fold_reports(spark, str(tmp_path))


def test_journal_keeps_bad_lines(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"trade_date": "2024-01-02", "code": "A", "nonce": "n"}\n{oops\n')
    rows = files.read_journal(spark, str(tmp_path)).collect()
    assert sorted((r.code, r._bad) for r in rows if r.code) == [("A", None)] and sum(r._bad is not None for r in rows) == 1


def test_wide_industries_and_panel(spark, tmp_path):
    spark.sql("select date'2024-01-02' as datetime, 1.0D as A, cast(null as double) as B").write.parquet(str(tmp_path / "w"))
    assert [(r.instrument, r.value) for r in files.read_wide(spark, str(tmp_path / "w")).collect()] == [("A", 1.0)]
    (tmp_path / "i.csv").write_text("Instrument,INDUSTRY\nA,steel\nA,steel\n")
    with pytest.raises(ValueError):
        files.read_industries(spark, str(tmp_path / "i.csv"))
    panel = files.random_panel(spark, 3, 300, 5)
    files.write_panel(panel, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 900 and back.where("close > 0").select("datetime", "instrument").distinct().count() == 900


def test_panel_aligned_from_each_names_first_day(spark, tmp_path):
    days = panels.calendar(spark.sql("select explode(array(date'2024-01-02', date'2024-01-03', date'2024-01-05', date'2024-01-08')) as datetime"))
    rows = spark.createDataFrame([("a", "2024-01-03", "1.5"), ("a", "2024-01-08", "x"), ("b", "2024-01-02", "2"), ("b", "2024-01-02", "3"), ("c", "2024-01-04", "9"), (None, "2024-01-02", "1")], "instrument string, datetime string, close string").withColumn("datetime", F.to_date("datetime"))
    files.write_aligned(rows, days, str(tmp_path / "p"), ("close", "money"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert dict(back.dtypes)["close"] == dict(back.dtypes)["money"] == "float"
    got = sorted((r.instrument, r.datetime.day, r.start_index, r.close, r.money) for r in back.collect())
    want = [("a", 3, 1, 1.5, None), ("a", 5, 1, None, None), ("a", 8, 1, None, None), ("b", 2, 0, 2.0, None), ("b", 3, 0, None, None), ("b", 5, 0, None, None), ("b", 8, 0, None, None), ("c", 5, 2, None, None), ("c", 8, 2, None, None)]
    assert got == want
    assert panels.aligned(rows.limit(0), days, ("close",)).count() == 0 and panels.aligned(rows, days.limit(0), ("close",)).count() == 0


def test_codes(spark):
    row = spark.range(1).select(
        codes.to_prefixed(F.lit("600000.SH")).alias("a"), codes.to_suffixed(F.lit("SZ000001")).alias("b"), codes.to_prefixed(F.lit("x")).alias("c"), codes.compact_date(F.lit("20240131")).cast("string").alias("d"), codes.compact_date(F.lit("20240231")).alias("e"),
        codes.announcement_token(F.lit("20220101.0")).alias("f"), codes.announcement_token(F.lit(" ")).alias("g"), codes.is_risk_name(F.lit("＊ＳＴ甲")).alias("h"), codes.is_risk_name(F.lit("STAR")).alias("i"), codes.board(F.lit("SH688001")).alias("j"), codes.board(F.lit("?")).alias("k"),
    ).first()
    assert tuple(row) == ("SH600000", "000001.SZ", "x", "2024-01-31", None, "20220101", None, True, False, "star", "other")


def test_event_bars_as_in_batch(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events.parquet*")
    got = drained(spark, streams.day_bars(stream.select("ts", "user_id", "value")), "bars_stream", "complete")
    want = catalog.all_queries()["event_bars"](spark, sf_dir)
    assert sorted(map(tuple, got.select("user_id", "day", "open", "n").collect())) == sorted(map(tuple, want.select("user_id", "day", "open", "n").collect()))


def test_journal_without_replays(spark, tmp_path):
    line = '{"trade_date": "2024-01-02", "code": "%s", "nonce": "n", "decided_at": "2024-01-02T0%d:00:00Z"}\n'
    (tmp_path / "j.jsonl").write_text(line % ("A", 1) + line % ("A", 2) + line % ("B", 1))
    got = drained(spark, streams.journal_once(spark.readStream.schema(files.JOURNAL).json(str(tmp_path))), "journal_stream")
    assert sorted(r.code for r in got.collect()) == ["A", "B"]


def test_statement_and_year_sinks(spark, tmp_path):
    one = spark.sql("select 'A' as code, date'2024-03-31' as period, 0 as update_flag, 'b1' as batch, 1.0D as revenue")
    one.withColumn("bucket", streams.bucket_of()).write.partitionBy("bucket").parquet(str(tmp_path / "store/batch_no=-1"))
    one.union(spark.sql("select 'B', date'2024-03-31', 0, 'b2', 2.0D")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(one.schema).parquet(str(tmp_path / "in"))
    streams.statement_sink(stream, str(tmp_path / "store"), lambda: codes.content_hash("period", "revenue")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.code for r in spark.read.parquet(str(tmp_path / "store")).collect()) == ["A", "B"]

    bars = spark.sql("select date'2023-01-02' as datetime, 'A' as instrument, 1.0D as close union all select date'2024-01-02', 'A', 1.0D")
    bars.withColumn("year", F.year("datetime")).write.partitionBy("year").parquet(str(tmp_path / "bars/batch_no=-1"))
    spark.sql("select date'2024-01-02' as datetime, 'A' as instrument, 9.0D as close").write.parquet(str(tmp_path / "new"))
    stream = spark.readStream.schema(bars.schema).parquet(str(tmp_path / "new"))
    streams.year_sink(stream, str(tmp_path / "bars")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(120)
    got = streams.current_years(spark.read.parquet(str(tmp_path / "bars")))
    assert sorted((str(r.datetime), r.close) for r in got.collect()) == [("2023-01-02", 1.0), ("2024-01-02", 9.0)]


def test_statement_sink_reads_touched_buckets_and_settles_a_batch(spark, tmp_path):
    schema = "code string, period date, update_flag int, batch string, revenue double"
    day = datetime.date(2024, 3, 31)
    spark.createDataFrame([(c, day, 0, "b1", 1.0) for c in "ABC"], schema).withColumn("bucket", streams.bucket_of()).write.partitionBy("bucket").parquet(str(tmp_path / "s/batch_no=-1"))
    spark.createDataFrame([("A", day, 0, "b3", 1.0), ("A", day, 0, "b2", 7.0), ("D", day, 0, "b2", 4.0), ("D", day, 0, "b3", 5.0)], schema).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # again from the start, as after a lost checkpoint
        sink = streams.statement_sink(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "s"), lambda: codes.content_hash("period", "revenue"))
        sink.option("checkpointLocation", str(tmp_path / f"c{_}")).trigger(availableNow=True).start().awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "s")).where("batch_no >= 0").collect()
    assert [(r.code, r.batch, r.revenue) for r in rows] == [("D", "b3", 5.0)]


def test_year_sink_takes_the_last_of_a_batch_and_compacts(spark, tmp_path):
    schema = "datetime date, instrument string, close double, seen int"

    def bar(year, close, seen):
        return (datetime.date(year, 1, 2), "A", close, seen)

    store = str(tmp_path / "bars")
    spark.createDataFrame([bar(2023, 1.0, 0), bar(2024, 1.0, 0)], schema).withColumn("year", F.year("datetime")).write.partitionBy("year").parquet(f"{store}/batch_no=-1")

    def run(rows, where):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.year_sink(stream, store, "seen").option("checkpointLocation", str(tmp_path / where)).trigger(availableNow=True).start().awaitTermination(120)
        return {r.datetime.year: r.close for r in streams.current_years(spark.read.parquet(store)).collect()}

    assert run([bar(2024, 5.0, 3), bar(2024, 4.0, 2), bar(2024, 9.0, 1)], "c") == {2023: 1.0, 2024: 5.0}
    assert run([bar(2024, 6.0, 4)], "c") == {2023: 1.0, 2024: 6.0}
    assert run([bar(2024, 7.0, 5), bar(2025, 2.0, 5)], "c") == {2023: 1.0, 2024: 7.0, 2025: 2.0}
    versions = sorted(p.name for p in (tmp_path / "bars").glob("batch_no=*/year=2024"))
    assert len(versions) == 2 and (tmp_path / "bars/batch_no=-1/year=2023").exists()
    # A restart that runs the last batch again finds it written and leaves it.
    (tmp_path / "c/commits/2").unlink()
    (tmp_path / "c/commits/.2.crc").unlink(missing_ok=True)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "bars").glob("batch_no=2/year=*/*.parquet")}
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    streams.year_sink(stream, store, "seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert before and {p: p.stat().st_mtime_ns for p in (tmp_path / "bars").glob("batch_no=2/year=*/*.parquet")} == before
    with pytest.raises(ValueError):
        streams.compact_years(spark, store, 0)
