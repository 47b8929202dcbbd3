import json

import pytest
from pyspark.sql import functions as F

from murmur.sources import scans, sinks
from murmur.streaming import profiles
from tests.conftest import DATA

KIND = "id string, name string"


def test_json_forms(spark, tmp_path):
    rows = [{"id": "1", "name": "a"}, {"id": "2", "name": "b"}]
    forms = {"l.jsonl": "\n".join(map(json.dumps, rows)) + "\n\n", "a.json": json.dumps(rows, indent=1), "w.json": json.dumps({"data": rows}), "m.json": json.dumps({"users": {"1": {"name": "a"}, "2": {"name": "b"}}}), "k.json": json.dumps({"1": {"name": "a"}, "2": {"id": "2", "name": "b"}, "n": 3})}
    for name, text in forms.items():
        (tmp_path / name).write_text(text)
        got = scans.read_records(spark, str(tmp_path / name), KIND).select("id", "name").collect()
        assert sorted(map(tuple, got)) == [("1", "a"), ("2", "b")], name
    (tmp_path / "bad.jsonl").write_text('{"id": \n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        scans.read_records(spark, str(tmp_path / "bad.jsonl"), KIND).collect()


def test_paths_and_maps(spark, tmp_path):
    for k in (2, 1):
        (tmp_path / f"tweet_{k}.json").write_text("[]")
    assert [p.rsplit("/", 1)[1] for p in scans.shards(spark, str(tmp_path))] == ["tweet_1.json", "tweet_2.json"]
    with pytest.raises(FileNotFoundError):
        scans.require_path(spark, str(tmp_path / "none"))
    assert scans.resolve(spark, str(tmp_path), "x.json", "tweet_1.json").endswith("tweet_1.json")
    (tmp_path / "m.csv").write_text("id,label\n1,bot\n1,human\n2,\n")
    csv = scans.read_csv(spark, str(tmp_path / "m.csv"))
    assert csv.where("label = ''").count() == 1
    last = scans.read_map(csv.withColumn("o", F.monotonically_increasing_id()), "label", "o")
    assert {r.id: r.label for r in last.collect()} == {"1": "human", "2": ""}
    ids = spark.createDataFrame([("1",)], "id string")
    assert scans.lookup(csv, ids, "id").count() == 1 and scans.unprocessed(csv, ids, "id").count() == 1


def test_sinks(spark, tmp_path):
    users = spark.createDataFrame([("u1", "train", "bot")], "user_id string, split string, label string")
    edges = spark.createDataFrame([("u1", "t1", "post")], "source_id string, target_id string, relation string")
    tables = {"user": users, "tweet": spark.createDataFrame([("t1",)], "tweet_id string"), "edge": edges}
    at = str(tmp_path / "sample")
    sinks.export_sample(tables, at, {"seed": 42})
    assert scans.read_manifest(spark, f"{at}/manifest.json") == {"seed": 42, "distributions": {"split": {"train": 1}, "label": {"bot": 1}, "relation": {"post": 1}}}
    assert scans.read_csv(spark, f"{at}/edge.csv").first().relation == "post"
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.export_sample(tables, at, {})
    with pytest.raises(ValueError, match="unexpected"):
        sinks.write_csv(users, str(tmp_path / "x"), ["user_id"])
    rows = users.withColumn("error", F.when(F.col("label") == "bot", "bad"))
    sinks.write_split(rows, str(tmp_path / "good"), str(tmp_path / "dead"))
    assert spark.read.json(str(tmp_path / "dead")).count() == 1


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    events = spark.read.parquet(f"{DATA}/sf0.001/events.parquet")
    events.repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
    stream = profiles.read_events(spark, str(tmp_path / "in"))
    q = profiles.to_table(profiles.hour_profiles(stream), "hours")
    q.processAllAvailable()
    q.stop()
    got = {r.user_id: (r.dated, r.hours) for r in spark.sql("select * from hours").collect()}
    batch = events.groupBy("user_id").agg(F.count("*").alias("n"), F.array(*[F.count_if(F.hour("ts") == h) for h in range(24)]).alias("h"))
    assert got == {r.user_id: (r.n, r.h) for r in batch.collect()}
    q = profiles.to_table(profiles.windowed_types(profiles.read_events(spark, str(tmp_path / "in"), files_per_trigger=10), ["click"]), "types", "append")
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(events) s from types").first().s <= events.count()


def test_first_and_last_records_follow_the_files(spark, tmp_path):
    """Over files cut into many splits, which tasks take by size and not in order."""
    rows = [(f"u{k * 7 % 50}", f"v{k}" + "x" * (k % 30)) for k in range(600)]
    (tmp_path / "label.csv").write_text("id,label\n" + "\n".join(map(",".join, rows)))
    for name, part in (("tweet_1.jsonl", rows[:250]), ("tweet_2.jsonl", rows[250:])):
        (tmp_path / name).write_text("\n".join(json.dumps({"id": a, "name": b}) for a, b in part))
    (tmp_path / "a.json").write_text(json.dumps([{"id": a, "name": b} for a, b in rows]))
    (tmp_path / "w.json").write_text(json.dumps({"data": [{"id": a, "name": b} for a, b in rows]}))
    first = {}
    for a, b in rows:
        first.setdefault(a, b)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        cells = scans.read_csv(spark, str(tmp_path / "label.csv"), "at")
        assert cells.rdd.getNumPartitions() > 8
        assert dict(map(tuple, scans.read_map(cells, "label", "at").collect())) == dict(rows)
        shards = scans.read_jsonl(spark, scans.shards(spark, str(tmp_path)), KIND, "place")
        assert dict(map(tuple, scans.first_of(shards, "id").collect())) == first
        for name in ("a.json", "w.json"):
            assert dict(map(tuple, scans.first_of(scans.read_records(spark, str(tmp_path / name), KIND, "place"), "id").collect())) == first
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
