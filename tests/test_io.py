"""JSON-lines readers, sinks, sampling and the streaming ingest."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from offerscope.operators import prepare
from offerscope.operators.ordering import numbered
from offerscope.sources import jsonl, loads
from offerscope.sources import tables as sinks
from offerscope.streaming import start_ingest


def _write_lines(path, lines):
    with open(path, "w") as fh:
        fh.write("\n".join(lines) + "\n")


def test_read_events_jsonl_blank_lines_and_key_spellings(spark):
    d = tempfile.mkdtemp(prefix="offerscope-io-", dir="/tmp")
    path = os.path.join(d, "transcript.json")
    _write_lines(path, [
        json.dumps({"person": "p1", "event": "offer received", "value": {"offer id": "a_1"}, "time": 0}),
        "",
        json.dumps({"person": "p1", "event": "offer completed", "value": {"offer_id": "a_1", "reward": 2}, "time": 6}),
        json.dumps({"person": "p1", "event": "transaction", "value": {"amount": 3.5}, "time": 6}),
        json.dumps({"person": "p2", "event": "offer viewed", "value": {"offer_id": "", "offer id": "b 2"}, "time": 12}),
    ])
    out = jsonl.load_events(spark, path).orderBy("time", "person").collect()
    assert len(out) == 4
    assert [r["offer_id"] for r in out] == ["a_1", "a_1", None, "b 2"]
    assert out[1]["reward"] == 2.0 and out[2]["amount"] == 3.5
    assert json.loads(out[0]["value"]) == {"offer id": "a_1"}


def test_read_offers_and_profiles(spark):
    d = tempfile.mkdtemp(prefix="offerscope-io-", dir="/tmp")
    offers = os.path.join(d, "portfolio.json")
    _write_lines(offers, [json.dumps({"id": "x", "reward": 5, "difficulty": 10, "duration": 7,
                                      "offer_type": "bogo", "channels": ["web", "email"]})])
    row = jsonl.load_offers(spark, offers).collect()[0]
    assert (row["web"], row["email"], row["mobile"], row["social"]) == (1, 1, 0, 0)
    assert json.loads(row["channels"]) == ["web", "email"]
    prof = os.path.join(d, "profile.json")
    _write_lines(prof, [json.dumps({"gender": None, "age": 118, "id": "p", "became_member_on": 20170212,
                                    "income": None})])
    p = jsonl.read_profiles(spark, prof).collect()[0]
    assert p["age"] == 118 and p["became_member_on"] == 20170212


def test_csv_export_and_exact_sample(spark, tables):
    from offerscope.sources import tables as sinks
    d = tempfile.mkdtemp(prefix="offerscope-io-", dir="/tmp")
    out_dir = os.path.join(d, "profile_csv")
    sinks.export_csv(tables.profile, out_dir)
    back = spark.read.option("header", True).csv(out_dir)
    assert back.count() == tables.profile.count()
    sample = sinks.sample_exact(tables.flat, 7, seed=3)
    assert sample.count() == 7
    assert sorted(map(tuple, sample.collect())) == sorted(map(tuple, sinks.sample_exact(tables.flat, 7, seed=3).collect()))


def test_streaming_ingest_available_now(spark):
    base = tempfile.mkdtemp(prefix="offerscope-stream-", dir="/tmp")
    src, sink, ckpt = (os.path.join(base, x) for x in ("in", "out", "ckpt"))
    os.makedirs(src)
    _write_lines(os.path.join(src, "part-0.json"), [
        json.dumps({"person": "p", "event": "offer received", "value": {"offer id": "o"}, "time": 0}),
        json.dumps({"person": "p", "event": "transaction", "value": {"amount": 1.25}, "time": 1})])
    q = start_ingest(spark, src, sink, ckpt, available_now=True)
    q.awaitTermination(120)
    _write_lines(os.path.join(src, "part-1.json"), [
        json.dumps({"person": "q", "event": "offer completed", "value": {"offer_id": "o", "reward": 5}, "time": 2})])
    q = start_ingest(spark, src, sink, ckpt, available_now=True)
    q.awaitTermination(120)
    out = spark.read.parquet(sink)
    assert out.count() == 3
    assert out.filter(F.col("offer_id") == "o").count() == 2


def test_tables_roundtrip(spark, tables):
    name = "offerscope_test_offers"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    from offerscope.sources import tables as sinks
    sinks.append_table(tables.offers, name)
    sinks.append_table(tables.offers, name)
    assert spark.table(name).count() == 2 * tables.offers.count()
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_report_writes_each_analysis(spark, tables):
    from offerscope.report import run_report
    from offerscope.plans import ANALYSES
    out = tempfile.mkdtemp(prefix="offerscope-report-", dir="/tmp")
    names = ["kpi_view_completion_rate", "dq_underspend_window", "cln_impute_income"]
    timings = run_report(tables, out, names)
    assert set(timings) == set(names)
    for n in names:
        got = sorted(map(repr, spark.read.parquet(f"{out}/{n}").collect()))
        want = sorted(map(repr, ANALYSES[n](tables).collect()))
        assert got == want


def test_malformed_lines_are_kept_aside(spark):
    d = tempfile.mkdtemp(prefix="offerscope-io-", dir="/tmp")
    path = os.path.join(d, "bad.json")
    _write_lines(path, [json.dumps({"person": "p", "event": "transaction", "value": {"amount": 2.0}, "time": 1}),
                        "{not json"])
    df = jsonl.read_events(spark, path, corrupt_column="_corrupt_record").cache()
    rows = df.collect()
    assert len(rows) == 2
    bad = [r for r in rows if r["_corrupt_record"] is not None]
    assert len(bad) == 1 and bad[0]["_corrupt_record"] == "{not json"
    df.unpersist()


def _event(person="p", event="transaction", value=None, time=1, **more):
    return json.dumps({"person": person, "event": event, "value": {"amount": 2.0} if value is None else value, "time": time, **more})


def test_events_keep_unknown_keys(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="offerscope-io-", dir="/tmp"), "extra.json")
    value = {"offer id": "o_1", "coupon": {"code": "X", "uses": [1, 2]}, "note": None, "amount": 1.50}
    _write_lines(path, [_event(value=value), _event(value={"reward": 5, "offer_id": "o_2"}), _event(value={})])
    rows = jsonl.load_events(spark, path).orderBy(F.col("reward").asc_nulls_last(), F.col("amount").asc_nulls_last()).collect()
    assert [json.loads(r["value"]) for r in rows] == [{"reward": 5, "offer_id": "o_2"}, value, {}]
    assert [(r["offer_id"], r["amount"], r["reward"]) for r in rows] == [("o_2", None, 5.0), ("o_1", 1.5, None), (None, None, None)]


def test_written_events_read_back(spark, tables):
    path = os.path.join(tempfile.mkdtemp(prefix="offerscope-io-", dir="/tmp"), "transcript")
    jsonl.write_events(tables.transcript, path)
    back = prepare.flatten_events(jsonl.read_events(spark, path))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, tables.flat.collect()))


BAD = {"{not json": "not JSON", "[1, 2]": "not an object", "null": "not an object", '"text"': "not an object",
       '{"person": "p", "event": "e", "value": {}}': "time is missing", '{"person": null, "event": "e", "value": {}, "time": 1}': "person is missing",
       '{"person": "p", "value": {}, "time": 1}': "event is missing", '{"person": "p", "event": "e", "value": {}, "time": "soon"}': "time is not an int",
       '{"person": "p", "event": "e", "value": 5, "time": 1}': "value is not an object"}


def test_faulty_lines_are_told_apart(spark):
    folder = tempfile.mkdtemp(prefix="offerscope-io-", dir="/tmp")
    good = [_event(), _event(person="q", extra=[1]), _event(time="7")]
    _write_lines(os.path.join(folder, "a.json"), [good[0], "", "   ", *BAD])
    _write_lines(os.path.join(folder, "b.json"), good[1:])
    events, faults = jsonl.checked_events(spark, folder, strict=False)
    assert sorted((r["person"], r["time"]) for r in events.collect()) == [("p", 1), ("p", 7), ("q", 1)]
    found = faults.collect()
    assert {r["line"]: r["reason"] for r in found} == BAD and all(r["file"].endswith("/a.json") for r in found)
    assert events.count() + len(found) == len(BAD) + len(good)
    assert prepare.flatten_events(events).agg(F.sum("amount")).first()[0] == 6.0
    strict, faults = jsonl.checked_events(spark, folder)
    with pytest.raises(Exception, match="malformed event in .*a.json"):
        strict.collect()
    assert faults.count() == len(BAD)
    clean, none = jsonl.checked_events(spark, os.path.join(folder, "b.json"))
    assert clean.count() == 2 and none.count() == 0


def test_append_of_the_same_files_adds_nothing(spark):
    base = tempfile.mkdtemp(prefix="offerscope-io-", dir="/tmp")
    src, table = os.path.join(base, "in"), os.path.join(base, "table")
    os.makedirs(src)
    _write_lines(os.path.join(src, "a.json"), [_event(time=k) for k in range(5)])
    _write_lines(os.path.join(src, "b.json"), [_event(time=k) for k in range(5)])
    assert loads.manifest(spark, table).count() == 0
    assert loads.append_files(spark, table, src, jsonl.load_events) == 2
    assert loads.append_files(spark, table, src, jsonl.load_events) == 0
    assert loads.loaded(spark, table).count() == 10
    # A new file and a changed one are new loads; the others are not.
    _write_lines(os.path.join(src, "c.json"), [_event()])
    _write_lines(os.path.join(src, "a.json"), [_event(time=k) for k in range(6)])
    assert loads.append_files(spark, table, src, jsonl.load_events) == 2
    assert sorted(r["n_rows"] for r in loads.manifest(spark, table).collect()) == [1, 5, 5, 6]
    # A load that broke off is written anew in its place.
    broken = [d for d in os.listdir(table) if d.startswith("load=c.json")][0]
    for f in os.listdir(os.path.join(table, broken)):
        os.remove(os.path.join(table, broken, f))
    assert loads.append_files(spark, table, src, jsonl.load_events) == 1
    assert loads.loaded(spark, table).count() == 17
    assert loads.append_files(spark, table, src, jsonl.load_events, again=True) == 3
    assert loads.loaded(spark, table).count() == 17 + 12


def test_sample_and_preview_do_not_depend_on_partitioning(tables):
    log = tables.flat
    for take in (lambda df: sinks.sample_exact(df, 50, seed=9), sinks.preview):
        first = sorted(map(repr, take(log).collect()))
        assert first == sorted(map(repr, take(log.repartition(7)).collect())) == sorted(map(repr, take(log.coalesce(1)).collect()))
    assert sorted(map(repr, sinks.sample_exact(log, 50, seed=9).collect())) != sorted(map(repr, sinks.sample_exact(log, 50, seed=8).collect()))
    assert sinks.sample_exact(log.limit(3), 50).count() == 3 and sinks.sample_exact(log.where("false"), 5).count() == 0


def test_unknown_channel_gets_its_flag(spark):
    rows = [("o1", ["web", "pigeon"]), ("o2", []), ("o3", None), ("o4", ["email"])]
    frame = spark.createDataFrame(rows, "id string, channels array<string>")
    group = "channel-flags"
    spark.sparkContext.setJobGroup(group, group)
    found = prepare.channel_flags(frame)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    names = ["email", "pigeon", "web"]
    assert {r["id"]: r["flags"] for r in found.collect()} == {i: {n: int(n in (c or [])) for n in names} for i, c in rows}
    assert [r[0] for r in found.select(F.map_keys("flags")).collect()] == [names] * 4
    assert [r["flags"] for r in prepare.channel_flags(frame.where("id = 'o2'")).collect()] == [{}]


def test_numbered_rows(spark, tables):
    order = [F.col("time").desc(), F.col("person").asc()]
    got = numbered(tables.events, order).orderBy("row_no").collect()
    assert [r["row_no"] for r in got] == list(range(1, len(got) + 1))
    places = [(-r["time"], r["person"]) for r in got]
    assert places == sorted(places)
    again = numbered(tables.events.repartition(5), order).orderBy("row_no").collect()
    assert got == again
    assert numbered(tables.events.where("false"), order).count() == 0
