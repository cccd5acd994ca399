"""Readers of transcript stores, the SQLite source, source files and streams."""

import json
import sqlite3

from pyspark.sql import functions as F

from heddle.functions.text import decoded_directory, timestamp_of_epoch, title, title_from_path, trimmed, valid_identifiers
from heddle.operators import inventory
from heddle.plans.samples import SOURCES, STORE1
from heddle.sources import sqlite, stores
from heddle.sources.code import source_files
from heddle.streaming.sessions import drain_sessions, event_stream, windowed_counts


def put(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text if isinstance(text, str) else "\n".join(text), encoding="utf-8")
    return f"file://{root}"


def test_project_store(spark, tmp_path):
    found, said = stores.project_store(spark, put(tmp_path, STORE1))
    s = found.collect()
    assert [(r.id, r.title, r.message_count, str(r.first_at), str(r.last_at)) for r in s] == [("s1", "shop", 2, "2024-01-01 10:00:00", "2024-01-01 10:05:00")]
    got = {(r.session_id, r.line_no): (r.id, r.role, r.content) for r in said.collect()}
    assert got == {("s1", 5): ("u1", "user", "hello there"), ("s1", 6): ("a1", "assistant", "one\n\ntwo"), ("s2", 1): ("b1", "assistant", "no time")}


def test_session_store_over_several_roots(spark, tmp_path):
    a = put(tmp_path / "a", {"-work-x-/t_u_1.jsonl": ['{"type":"session","cwd":"/w/old"}', '{"type":"message","id":"m","timestamp":"2024-01-01T00:00:00+02:00","message":{"role":"user","content":[{"type":"text","text":" q "}]}}', '{"type":"session","cwd":"/w/new/"}'], "p/nounderscore.jsonl": ["{}"], ".hid/t_z.jsonl": ['{"type":"message","id":"m","timestamp":"2024-01-01T00:00:00Z","message":{"role":"user","content":"x"}}']})
    b = put(tmp_path / "b", {"-work-y-/t_v.jsonl": ['{"type":"message","id":"k","timestamp":"2024-01-02T00:00:00Z","message":{"role":"assistant","content":"r"}}']})
    found, said = stores.session_store(spark, [a, b, f"file://{tmp_path}/absent"])
    assert {(r.id, r.cwd, r.title) for r in found.collect()} == {("u_1", "/w/new/", "new"), ("v", "/work/y", "y")}
    assert {r.id: str(r.ts) for r in said.collect()} == {"u_1/m": "2023-12-31 22:00:00", "v/k": "2024-01-02 00:00:00"}


def test_thread_store_from_sqlite(spark, tmp_path):
    event = lambda kind, text, at="2024-01-03T00:00:00Z": json.dumps({"type": "event_msg", "timestamp": at, "payload": {"type": kind, "message": text}})
    put(tmp_path / "r" / "d", {"one.jsonl": ["", event("user_message", " hi "), "bad", event("agent_message", "yo", None), event("other", "x")], "empty.jsonl": [""]})
    path = str(tmp_path / "state_10.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE threads (id TEXT, rollout_path TEXT, title TEXT, first_user_message TEXT, cwd TEXT, created_at INT, updated_at INT)")
        db.executemany("INSERT INTO threads VALUES (?,?,?,?,?,?,?)", [("t1", f"{tmp_path}/r/d/one.jsonl", "", " first ", "/w/p", 1704067200, 1704240000), ("t2", f"{tmp_path}/r/d/empty.jsonl", "x", "", "", 1, 1), ("t3", "/nowhere.jsonl", "x", "", "", 1, 1), ("t4", None, "x", "", "", 1, 1)])
    threads = sqlite.read_table(spark, path)
    assert threads.count() == 4
    found, said = stores.thread_store(threads, stores.transcript_files(spark, [f"file://{tmp_path}/r"]))
    assert [(r.id, r.title, r.message_count, str(r.first_at), str(r.last_at)) for r in found.collect()] == [("t1", "first", 2, "2024-01-03 00:00:00", "2024-01-03 00:00:00")]
    assert {r.id: (r.role, r.content, str(r.ts)) for r in said.collect()} == {"evt_2": ("user", "hi", "2024-01-03 00:00:00"), "evt_4": ("assistant", "yo", "1970-01-01 00:00:00")}
    later, _ = stores.thread_store(threads, stores.transcript_files(spark, [f"file://{tmp_path}/r"]), since="2024-01-03 00:00:00")
    assert later.count() == 0
    doc = json.loads(stores.session_json(found, said).first().json)
    assert [m["id"] for m in doc["messages"]] == ["evt_4", "evt_2"] and doc["messageCount"] == 2


def test_absent_stores_are_empty(spark, tmp_path):
    assert stores.project_store(spark, f"file://{tmp_path}/none")[0].count() == 0
    assert sqlite.read_table(spark, None).count() == 0
    assert sqlite.read_table(spark, str(tmp_path / "none.sqlite")).count() == 0
    assert source_files(spark, f"file://{tmp_path}/none").count() == 0


def test_newest_state():
    assert sqlite.newest_state(["state_2.sqlite", "state_10.sqlite", "state.sqlite"]) == "state_10.sqlite"
    assert sqlite.newest_state(["state.sqlite"]) == "state.sqlite" and sqlite.newest_state(["x"]) is None


def test_string_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert [get(title_from_path(F.lit(p))) for p in ("C:\\a\\b", "/", "", "/a//b/")] == ["b", "/", "Unknown", "b"]
    assert get(title(F.lit(" "), F.lit("x" * 99), F.lit("/a"))) == "x" * 80
    assert get(decoded_directory(F.lit("--home-me--"))) == "/home/me"
    assert get(trimmed(F.lit("\ufeff\u3000 a b\t\n"))) == "a b"
    assert str(get(timestamp_of_epoch(F.lit(1704067200.0)))) == str(get(timestamp_of_epoch(F.lit(1704067200000.0)))) == "2024-01-01 00:00:00"
    assert get(timestamp_of_epoch(F.lit(0.0))) is None
    ids = F.expr("array(named_struct('type','Email','value','a@x','is_primary',true), named_struct('type','Odd','value','b','is_primary',false), named_struct('type','Email','value','2020-01-01','is_primary',false), named_struct('type','Email','value','Me','is_primary',false))")
    assert [(i.type, i.value) for i in get(valid_identifiers(ids, F.lit("me"), ("Email",)))] == [("Email", "a@x"), ("Nickname", "b")]


def test_source_listing_and_markdown(spark, tmp_path):
    root = put(tmp_path, SOURCES | {"node_modules/x.ts": "const A = 1;", ".venv/y.py": "A = 1"})
    files = source_files(spark, root)
    assert {r.path for r in files.collect()} == set(SOURCES)
    tracked = spark.createDataFrame([("src/shop/models.py",), ("src/shop/api.py",)], "path string")
    found = inventory.inventory(source_files(spark, root, tracked))
    doc = {r.file: r.markdown for r in inventory.markdown(found, inventory.import_edges(found)).collect()}
    assert "| class | `Item` | 10-14 | yes |" in doc["src/shop/models.py"]
    assert "- `src/shop/api.py` imports: Item, LIMIT, models" in doc["src/shop/models.py"]
    assert "Total lines: 18" in doc["src/shop/models.py"]


def test_scanners_survive_odd_files():
    for scan in inventory.SCANNERS.values():
        for text in ("", "{{{", "'", '"""', "/* open", "`${", "#[", "use ;", "export {", "\x00", "class", "fn", "import"):
            assert isinstance(scan(text, "x"), list)
    assert [r.kind for r in inventory.scan_python("def f(:")] == ["error"]


def test_rust_and_dart_details():
    rust = inventory.scan_rust('#[derive(\n  Debug,\n)]\npub enum E { A }\nfn f<\'a>(x: &\'a str) -> char { \'}\' }\nconst R: &str = r#"fn no() {"#;\n')
    assert [(r.kind, r.name, r.start, r.end) for r in rust if r.section == "decl"] == [("enum", "E", 4, 4), ("fn", "f", 5, 5), ("const", "R", 6, 6)]
    assert [r.text for r in rust if r.section == "signal"] == ["#[derive( Debug, )]"]
    dart = inventory.scan_dart("@Deprecated('x')\nabstract final class A extends State<B> {}\nFuture<Map<String, int>> go<T>(T x) async { if (x) {} }\nvar n = f(1);\n")
    assert [(r.kind, r.name) for r in dart if r.section == "decl"] == [("state", "A"), ("function", "go"), ("const", "n")]


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(i % 3, f"2024-01-0{1 + i % 4} 0{i % 9}:00:00", "a" if i % 2 else "b") for i in range(40)]
    df = spark.createDataFrame(rows, "u long, t string, kind string").withColumn("ts", F.to_timestamp("t")).drop("t")
    path = f"file://{tmp_path}/events"
    df.repartition(4).write.parquet(path)
    stream = event_stream(spark, path, df.schema)
    want = {r.u: r.n for r in df.groupBy("u").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r.session_id: r.message_count for r in drain_sessions(stream, "u", "ts").collect()} == want
    q = windowed_counts(stream, "ts", "kind").writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    closed = {(str(r.window_start), r.kind): r.n for r in spark.table("closed").collect()}
    batch = {(str(r.d), r.kind): r["count"] for r in df.groupBy(F.date_trunc("day", "ts").alias("d"), "kind").count().collect()}
    assert closed and all(batch[k] == v for k, v in closed.items())
