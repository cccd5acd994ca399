"""Whole runs: idempotence, budgets, snapshots."""

from pyspark.sql import functions as F

from heddle.operators import store
from heddle.plans.runs import collect, tend
from heddle.plans.storage import materialize, shared_path

CURSOR = "tool string, session_id long, status string, at timestamp"


def inputs(spark):
    said = [(s, n, "user" if n % 2 == 0 else "assistant", f"talk about topic{s} number {n}") for s in range(6) for n in range(2 if s == 1 else 6)]
    messages = spark.createDataFrame(said, "session_id long, n long, role string, text string")
    listed = spark.createDataFrame([("t", s, 100 + s) for s in range(6)], "tool string, session_id long, e long").select("tool", "session_id", F.timestamp_seconds("e").alias("last_at"))
    return listed, messages


def test_collection_runs_until_nothing_is_left(spark):
    listed, messages = inputs(spark)
    cursor, taken = spark.createDataFrame([], CURSOR), []
    for _ in range(4):
        run = collect(listed, messages, cursor, "host", "2024-02-01")
        cursor = materialize(run["cursor"], "test-cursor")
        report = run["report"].first()
        assert report.processed <= 3
        taken.append(sorted({r.session_id for r in run["records"].collect()}))
    assert taken == [[0, 2, 3], [4, 5], [], []]
    assert {r.session_id: r.status for r in cursor.collect()} == {s: "skipped-trivial" if s == 1 else "processed" for s in range(6)}


def test_hygiene_run(spark):
    items = [(i, f"word{i} " * 5, 10) for i in range(4)] + [(4, "word0 " * 5, 10_000_000), (5, "y" * 800, 10_000_000)]
    items = spark.createDataFrame(items, "id long, text string, e long").select("id", "text", F.timestamp_seconds("e").alias("touched"))
    facts = spark.createDataFrame([(1, "s", "p", "a", 1), (2, "s", "p", "b", 2)], "fact_id long, subject string, predicate string, object string, e int").withColumn("at", F.timestamp_seconds("e"))
    links = spark.createDataFrame([(0, 1), (2, 3), (4, 4)], "src long, dst long")
    run = tend(items, items.where("id = 2").select("id"), facts, links, "1970-04-01 00:00:00")
    got = {(r.op, r.target_id) for r in run["mutations"].collect()}
    assert got == {("merge", 4), ("decay", 0), ("decay", 1), ("decay", 3), ("split", 5), ("invalidate", 1), ("reconnect", 5)}
    assert [(r.target_id, r.replaced_by, r.outcome) for r in run["removals"].collect()] == [(4, 0, "proposed")]
    r = run["report"].first()
    assert (r.n_merge, r.n_decay, r.used, r.resume_point) == (1, 3, 7, "clean")
    notable = spark.createDataFrame([("first", 1), ("second", 2), (None, 3)], "name string, at int").withColumn("at", F.timestamp_seconds("at"))
    entry = store.diary(run["report"], notable)
    assert entry.first().text == "The interval brought 3 records. New: second. New: first. Garden health: " + entry.first().text.partition("health: ")[2]
    assert "merge 1, decay 3" in entry.first().text
    have = spark.createDataFrame([("a", "diary"), ("a", "graph"), ("b", "graph")], "store string, capability string")
    assert sorted((r.store, r.kind, r.tags) for r in store.diary_records(entry, have).collect()) == [("a", "diary", []), ("b", "memory", ["garden-summary"])]


def test_snapshots(spark):
    path, schema = shared_path(spark, "test-versions"), "a long, b string"
    assert store.read_version(spark, path, schema)[1] == 0
    for k in range(3):
        assert store.write_version(spark.createDataFrame([(k, "x")], schema), path) == k + 1
    df, version = store.read_version(spark, path, schema)
    assert version == 3 and df.first().a == 2


def test_fields_without_a_home_are_dropped(spark):
    df = spark.createDataFrame([("x", "1.5", "zz")], "name string, strength string, odd string")
    schema = spark.createDataFrame([], "name string, strength double, extra int").schema
    assert [tuple(r) for r in store.shaped(df, schema).collect()] == [("x", 1.5, None)]
