import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from jobs import keyword_index, usage_ledger
from jobs.settings import defaults, from_command_line
from loomwright.streaming import usage
from loomwright.streaming.usage import DailyLedger
from tools.oracle import normal

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@pytest.mark.parametrize("name", ["job1_keyword_index", "job2_usage_ledger"])
def test_same_rows_as_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "events"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, cursor = entry.queries()[name](spark, sf), con.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in cursor.description)
    names = [d[0] for d in cursor.description]
    assert columns == sorted(df.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns, columns) == normal(cursor.fetchall(), names, columns)


def config(tmp_path, **more):
    return defaults("usage_ledger") | {"source": str(tmp_path / "events"), "target": str(tmp_path / "usage")} | more


def ledger(spark, c):
    return sorted(map(tuple, DailyLedger(c["target"]).read(spark).collect()), key=str)


def batch_result(events):
    good = events.where(usage.usable_events(events)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    columns = ("user_id", "events", "kinds", "failed", "total", "first_at", "last_at", "day")
    return sorted(map(tuple, usage.merged_parts(usage.daily_parts(good)).select(*columns).collect()), key=str)


def test_takes_only_what_is_new(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    c = config(tmp_path)
    half = events.where("event_id % 2 = 0")
    half.repartition(3).write.parquet(c["source"])
    assert usage_ledger.run(spark, c) == {"batches": 1, "events": half.count()}
    assert ledger(spark, c) == batch_result(half)
    assert usage_ledger.run(spark, c) == {"batches": 0, "events": 0}
    assert ledger(spark, c) == batch_result(half)
    events.where("event_id % 2 = 1").repartition(2).write.mode("append").parquet(c["source"])
    assert usage_ledger.run(spark, c)["events"] == events.count() - half.count()
    assert ledger(spark, c) == batch_result(events)


@pytest.mark.parametrize("after", ["daily_parts", "merged_parts"])
def test_broken_off_and_run_again(spark, sf, tmp_path, monkeypatch, after):
    """A batch that dies before or between its writes is replayed and counts once."""
    events = spark.read.parquet(f"{sf}/events.parquet").limit(400).cache()
    c = config(tmp_path, files_per_batch=1)
    events.repartition(3).write.parquet(c["source"])
    plain, calls = getattr(usage, after), []

    def dies(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return plain(*args)

    monkeypatch.setattr(usage, after, dies)
    with pytest.raises(Exception, match="lost"):
        usage_ledger.run(spark, c)
    assert usage_ledger.run(spark, c)["batches"] == 2
    assert ledger(spark, c) == batch_result(events)


def test_refused_events_and_settings(spark, tmp_path):
    day = datetime(2024, 1, 1, 23, 30)
    rows = [(1, day, 7, "error", 1.005, None), (2, None, 7, "click", 1.0, None), (3, day, None, "click", 1.0, None), (4, day, 7, None, None, None)]
    c = config(tmp_path)
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(c["source"])
    zone = spark.conf.get("spark.sql.session.timeZone")
    assert usage_ledger.run(spark, c) == {"batches": 1, "events": 2}
    assert spark.conf.get("spark.sql.session.timeZone") == zone
    row = DailyLedger(c["target"]).read(spark).first()
    assert (row["user_id"], row["events"], row["kinds"], row["failed"]) == (7, 2, 1, 1)
    assert spark.read.parquet(f"{c['target']}/refused").count() == 2


def test_index_job_runs_again(spark, tmp_path):
    docs = [(1, "alpha beta beta gamma", "s"), (2, "beta", "s"), (3, None, "s"), (None, "beta", "s"), (4, "delta passage of words", None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(10, "beta"), (11, "passage of words"), (12, None)], "item_id long, text string").write.parquet(str(tmp_path / "q"))
    c = defaults("keyword_index") | {"documents": str(tmp_path / "d"), "questions": str(tmp_path / "q"), "target": str(tmp_path / "t"), "slices": 2}
    told = keyword_index.run(spark, c)
    assert told == {"documents": 3, "questions": 2, "answers": 3}
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t" / "answers")).select("item_id", "rank", "doc_id", "quotes").collect())
    assert read() == [(10, 1, 1, True), (10, 2, 2, True), (11, 1, 4, True)]
    assert keyword_index.run(spark, c) == told and read() == [(10, 1, 1, True), (10, 2, 2, True), (11, 1, 4, True)]


def test_config(tmp_path):
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"source": "/a", "files_per_batch": 5}))
    got = from_command_line("usage_ledger", "", ["--config", str(file), "--target", "/b"])
    assert got == defaults("usage_ledger") | {"source": "/a", "files_per_batch": 5, "target": "/b"}
    file.write_text(json.dumps({"sauce": 1}))
    with pytest.raises(ValueError, match="sauce"):
        from_command_line("usage_ledger", "", ["--config", str(file)])
