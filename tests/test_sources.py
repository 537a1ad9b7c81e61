"""Readers, sinks and streams on small files."""

import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from factloom.sources import exports, sinks
from factloom.streaming import ingest, windows


def node(i, parent, children, text=None, role="user", hidden=False, kind="text", parts=None):
    message = None
    if text is not None or parts is not None:
        message = {"author": {"role": role}, "content": {"content_type": kind, "parts": parts or [text]}, "create_time": 1704067200 + len(i), "metadata": {"is_visually_hidden_from_conversation": hidden}}
    return {"id": i, "parent": parent, "children": children, "message": message}


TREE = {
    "title": "T", "id": "c1", "create_time": 1704067200.0, "update_time": 1704067300.0,
    "mapping": {
        "root": node("root", None, ["a"]), "a": node("a", "root", ["b", "c"], "hello"), "b": node("b", "a", ["d"], "hi there", "assistant"), "c": node("c", "a", [], "  "),
        "d": node("d", "b", ["a"], "secret", hidden=True), "e": node("e", "zz", [], "stray"), "f": node("f", "b", []),
    },
}


def test_tree_order_and_drops(spark, tmp_path):
    multi = {**TREE, "id": "c2", "mapping": {"r": node("r", None, [], parts=["see", {"audio_transcription": {"text": "spoken"}}, {"asset": 1}], kind="multimodal_text")}}
    (tmp_path / "conversations.json").write_text(json.dumps([TREE, multi]))
    got = exports.chat_tree_export(spark, str(tmp_path)).orderBy("conversation_id", "sequence_order").collect()
    assert [(r.conversation_id, r.message_id, r.sequence_order, r.content_text) for r in got] == [("c1", "a", 0, "hello"), ("c1", "b", 1, "hi there"), ("c2", "r", 0, "see\nspoken\n[media]")]
    known = spark.createDataFrame([("c1",)], "conversation_id string")
    assert {r.conversation_id for r in exports.chat_tree_export(spark, str(tmp_path), known).collect()} == {"c2"}


def test_list_export_from_a_zip_with_a_climbing_path(spark, tmp_path):
    value = [{"uuid": "u1", "name": "N", "created_at": "2024-01-01T00:00:00Z", "chat_messages": [{"uuid": "m1", "sender": "human", "text": "question"}, {"sender": "assistant", "content": [{"type": "text", "text": "answer"}, {"type": "image"}]}]}]
    with zipfile.ZipFile(tmp_path / "data.zip", "w") as z:
        z.writestr("in/list.json", json.dumps(value))
        z.writestr("../../evil.json", json.dumps(value))
    got = exports.chat_list_export(spark, str(tmp_path)).orderBy("sequence_order").collect()
    assert [(r.role, r.content_text, r.created_at) for r in got] == [("user", "question", 1704067200.0), ("assistant", "answer", 1704067200.0)]


def test_agent_sessions(spark, tmp_path):
    lines = [
        {"type": "summary"}, {"type": "user", "uuid": "1", "timestamp": "2024-01-01T00:00:00Z", "message": {"content": "Fix the bug"}},
        {"type": "assistant", "uuid": "2", "timestamp": 1704067260000, "message": {"content": [{"type": "text", "text": "Done"}, {"type": "tool_use", "name": "run"}, {"type": "tool_result"}]}},
    ]
    (tmp_path / "s1.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    m = exports.agent_sessions(spark, str(tmp_path))
    assert [(r.role, r.content_text) for r in m.orderBy("at").collect()] == [("user", "Fix the bug"), ("assistant", "Done\n[tool: run]\n[tool result]")]
    head = exports.session_heads(m).first()
    assert (head.title, head.created_at, head.updated_at, head.message_count) == ("Fix the bug", 1704067200.0, 1704067260.0, 2)


def test_json_walk():
    long, other = "x" * 60, "y" * 60
    assert exports.texts_in({"a": [{"text": long}, {"text": long}, {"z": other}]}) == [long]
    assert exports.texts_in({"a": {"b": [other, "short"]}}) == [other]
    deep = other
    for _ in range(30):
        deep = [deep]
    assert exports.texts_in(deep) == []


def test_text_files(spark, tmp_path):
    (tmp_path / "my_note.txt").write_text("word " * 20)
    (tmp_path / "old.md").write_bytes(("caf\xe9 " * 20).encode("latin-1"))
    (tmp_path / "tiny.rst").write_text("no")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document>" + "<w:p><w:r><w:t>Some &amp; words in a paragraph here</w:t></w:r></w:p>" * 2 + "</w:document>")
    docs, skipped = exports.text_files(spark, str(tmp_path))
    got = {r.title: r for r in docs.collect()}
    assert set(got) == {"My Note", "Old", "D"} and got["Old"].content_text.startswith("café") and got["D"].content_text.count("Some & words") == 2
    assert [r.n for r in skipped.collect()] == [2]


def test_layers_trees_maps_and_detection(spark, tmp_path):
    (tmp_path / "core.md").write_text("---\nv: 1\n---\nignored\n## Injectable Block\nThe text\n")
    (tmp_path / "b.md").write_text("v: 1\n\n---\nafter\n")
    assert {r.layer: r.text for r in exports.layer_files(spark, str(tmp_path)).collect()} == {"core": "The text", "b": "after"}
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.json").write_text(json.dumps({"root": {"themes": [{"statement": "s", "fact_ids": ["1"]}]}, "stamp": "x"}))
    (tmp_path / "t/b.json").write_text(json.dumps({"leaf": 1}))
    assert [r.root.themes[0].statement for r in exports.distillation_trees(spark, str(tmp_path / "t")).collect()] == ["s"]
    (tmp_path / "m.txt").write_text(json.dumps({"Rex": "dog", "Long": "z" * 1001}))
    assert [tuple(r) for r in exports.entity_map(spark, str(tmp_path / "m.txt")).collect()] == [("rex", "dog")]
    assert [exports.detect_source(p) for p in ("a/x.jsonl", "conversations.json", "d.zip", "k.json", "n.md", "q.exe")] == ["agent_sessions", "chat_tree_export", "chat_list_export", "json_texts", "text_files", "unknown"]
    assert exports.journal(spark, [("work", "I build"), ("x", " ")], 5).first().content_text == "[work] I build"
    assert exports.correction_patterns(spark.createDataFrame([('["A"]',), ("bad",)], "p string"), "p").first().pattern == "a"


def test_sinks(spark, tmp_path):
    facts = spark.createDataFrame([(1, None, "current", 0.9, "extraction"), (2, "x", "current", 0.5, "user"), (3, None, "past", 0.2, "extraction")], "fact_id long, superseded_by string, temporal_state string, confidence double, source string")
    changes = spark.createDataFrame([(1, "user_forget"), (2, "user_forget")], "fact_id long, by string")
    assert {r.fact_id: r.superseded_by for r in sinks.supersede(facts, changes).collect()} == {1: "user_forget", 2: "x", 3: None}
    judged = sinks.apply_judgments(facts, spark.createDataFrame([(1, 3), (3, 2)], "older long, newer long"))
    assert {r.fact_id: (r.temporal_state, round(r.confidence, 3)) for r in judged.collect()} == {1: ("past", 0.27), 2: ("current", 0.5), 3: ("past", 0.1)}
    assert [r.fact_id for r in sinks.reset(facts, ["user"]).collect()] == [2]
    path = str(tmp_path / "prov")
    rows = spark.createDataFrame([("A", "cited", 1), ("A", "vector", 2), ("B", "cited", 3)], "layer string, method string, f long")
    sinks.replace_partitions(rows, path, ["layer", "method"])
    sinks.replace_partitions(spark.createDataFrame([("A", "vector", 9)], rows.schema), path, ["layer", "method"])
    assert {r.f for r in spark.read.parquet(path).collect()} == {1, 9, 3}
    vectors = spark.createDataFrame([(1, [1.0]), (2, [0.5])], "id long, v array<double>")
    assert sinks.append_vectors(vectors, str(tmp_path / "vec"), "id") == 2 and sinks.append_vectors(vectors, str(tmp_path / "vec"), "id") == 0
    names = spark.createDataFrame([("core_v1_gen2_x",), ("core_v2_gen1_x",), ("core_v2_regen3_x",), ("other_v9_gen1",)], "name string")
    assert sinks.next_version(names, "core") == (3, 4) and sinks.next_version(names, "none") == (1, 1)
    merged = sinks.merge_counts(spark.createDataFrame([("a", 1, 5)], "k string, n long, t long"), spark.createDataFrame([("a", 2, 4), ("b", 1, 1)], "k string, n long, t long"), ["k"], "n", "t")
    assert {tuple(r) for r in merged.collect()} == {("a", 3, 5), ("b", 1, 1)}
    assert sinks.snapshot(spark, path, str(tmp_path / "snap"), 1).endswith("v=1")
    sinks.append_ledger(rows, str(tmp_path / "ledger"))
    sinks.append_ledger(rows, str(tmp_path / "ledger"))
    assert spark.read.json(str(tmp_path / "ledger")).count() == 6
    c = spark.createDataFrame([(2, 1, "old", 1), (1, 2, "new", 2)], "a long, b long, verdict string, judged_at long")
    assert [r.verdict for r in sinks.contradiction_rows(c, None).collect()] == ["new"]
    text = sinks.payload(spark.createDataFrame([("core", "t")], "layer string, text string"), spark.createDataFrame([("goal", 2)], "category string, n long"))
    assert json.loads(text) == {"layers": {"core": "t"}, "distribution": {"goal": 2}}


def test_stream_appends_once(spark, sf, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs.where("doc_id < 50").write.parquet(source)
    ingest.append_once(ingest.read_new_files(spark, source, docs.schema), target, mark, "doc_id").awaitTermination()
    docs.where("doc_id < 80").write.mode("append").parquet(source)
    ingest.append_once(ingest.read_new_files(spark, source, docs.schema), target, mark, "doc_id").awaitTermination()
    got = spark.read.option("recursiveFileLookup", "true").parquet(target)
    assert got.count() == 80 == got.select("doc_id").distinct().count()


def test_stream_windows_equal_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = ingest.read_new_files(spark, str(tmp_path / "e"), e.schema)
    out = windows.windowed_counts(stream, "ts", ["event_type"], "1 hour", late="40 days")
    q = out.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r) for r in windows.windowed_counts(e, "ts", ["event_type"], "1 hour").collect()}
    assert {tuple(r) for r in spark.table("counted").collect()} == want


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    schema = "ts timestamp, k string"
    path = str(tmp_path / "late")

    def put(*rows):
        spark.createDataFrame(rows, "ts string, k string").select(F.to_timestamp("ts").alias("ts"), "k").coalesce(1).write.mode("append").parquet(path)

    put(("2024-01-01 10:00:00", "a"), ("2024-01-01 12:00:00", "a"))
    stream = ingest.read_new_files(spark, path, schema)
    mark, target = str(tmp_path / "m"), str(tmp_path / "o")

    def go():
        windows.windowed_counts(stream, "ts", ["k"], "1 hour", late="30 minutes").writeStream.format("parquet").option("path", target).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    go()
    put(("2024-01-01 10:30:00", "a"))  # closed by then
    put(("2024-01-01 15:00:00", "a"))
    go()
    go()
    got = {str(r.start): r.n for r in spark.read.parquet(target).collect()}
    assert got == {"2024-01-01 10:00:00": 1, "2024-01-01 12:00:00": 1}


def test_ledger_resumes(spark):
    chunks = spark.createDataFrame([("c1", 2), ("c2", 0), ("c3", 1)], "custom_id string, n long")
    process = lambda df: df.select("custom_id", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("fact"))
    _, ledger = ingest.process_with_ledger(chunks.where("custom_id <> 'c3'"), None, process)
    assert {tuple(r) for r in ledger.collect()} == {("c1", 2), ("c2", 0)}
    results, more = ingest.process_with_ledger(chunks, ledger.unionByName(spark.createDataFrame([("c3", -1)], "custom_id string, n long")), process)
    assert results.count() == 0 and more.count() == 0
    results, more = ingest.process_with_ledger(chunks, ledger.unionByName(spark.createDataFrame([("c3", -1)], "custom_id string, n long")), process, retry_errors=True)
    assert [tuple(r) for r in more.collect()] == [("c3", 1)]


def test_session_buffer(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.createDataFrame([("a", f"v{k}") for k in range(14)] + [("b", "w")], "k string, v string").coalesce(1).write.parquet(path)
    out = ingest.session_buffer(ingest.read_new_files(spark, path, "k string, v string"), "k", "v")
    q = out.writeStream.format("memory").queryName("buffers").outputMode("update").start()
    try:  # a processing-time timeout keeps the query alive, so it is stopped once the rows are there
        for _ in range(300):
            if spark.table("buffers").count() >= 2:
                break
            time.sleep(0.2)
        got = {r.k: (len(r.buffer), r.n_seen) for r in spark.table("buffers").collect()}
    finally:
        q.stop()
    assert got == {"a": (10, 14), "b": (1, 1)}


@pytest.mark.parametrize("value, want", [(None, None), ("", None), ("abc", None), (1704067200000, 1704067200.0), ("1704067200", 1704067200.0), ("2024-01-01T00:00:00Z", 1704067200.0)])
def test_seconds(value, want):
    assert exports.seconds(value) == want
