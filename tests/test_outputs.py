import json
import os
import pathlib
import random
import re
import subprocess
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import __spark_entry__ as entry
import stand_ins
from bindery.catalog.q_prompts import shortened
from bindery.operators import fragments as FR, structure as ST, versions as W
from bindery.plans import generation as G, prompts as P
from bindery.sources import note_sink as NS, notes as N, readers as RD
from bindery.streaming import jobs as JB
from bindery.operators import runs as R

L = F.lit


def test_render_is_single_pass(one):
    values = F.create_map(L("source_text"), L("值 {{title}} $1 \\"), L("title"), L("题"))
    assert one(P.render_template(L("{{title}}：{{source_text}}|{{gone}}"), values)) == "题：值 {{title}} $1 \\|"


def test_template_errors(one):
    arr = lambda *x: F.array(*[L(i) for i in x]) if x else F.array().cast("array<string>")
    assert one(P.template_errors(L("{{a}} {{b}}"), arr("a"), arr("a", "c"))) == ["存在未知占位符：b", "缺少必要占位符：c"]
    assert one(P.template_errors(L("{{a}} {{"), arr("a"), arr())) == ["提示词占位符花括号不完整"]


def album(spark):
    projects = spark.createDataFrame([("p", " 专 \n 辑 "), ("q", "空")], "project_id string, title string")
    episodes = spark.createDataFrame([("p", "e2", 2, "二\n题"), ("p", "e1", 1, "一"), ("p", "e3", 3, " ")], "project_id string, episode_id string, position int, title string")
    artifacts = spark.createDataFrame(
        [("e1", "final", 1, "旧"), ("e1", "final", 2, "人工\n"), ("e1", "draft", 3, "稿"), ("e3", "final", 1, "三")], "episode_id string, stage string, version int, content string"
    )
    return projects, episodes, W.latest_artifact(artifacts).filter("stage = 'final'")


def test_album_export(spark):
    got = {r["project_id"]: r["text"] for r in N.export_album(*album(spark)).collect()}
    assert got["p"] == "# 专 辑\n\n## 第 01 集：一\n\n人工\n\n## 第 02 集：二 题\n\n> 本集终稿尚未生成\n\n## 第 03 集：未命名声音\n\n三\n"
    assert got["q"] == "# 空\n\n> 当前专辑尚未创建声音。\n"


def test_same_titles_have_names_of_their_own(spark):
    df = spark.createDataFrame([("T", "knowledge_aaa"), ("T", "knowledge_bbb")], "t string, i string")
    assert len({r[0] for r in df.select(N.note_name(F.col("t"), F.col("i"))).collect()}) == 2


def test_note_merge(one):
    old = f"{N.SYSTEM_BEGIN}\n旧\n{N.SYSTEM_END}\n\n{N.USER_BEGIN}\n我的笔记\n{N.USER_END}\n"
    merged = one(N.merge_note(L(old), L(" 新 ")))
    assert "旧" not in merged and f"{N.SYSTEM_BEGIN}\n新\n{N.SYSTEM_END}" in merged and "我的笔记" in merged
    assert one(N.merge_note(L(None).cast("string"), L("x"))).endswith(f"{N.USER_BEGIN}\n\n{N.USER_END}\n")


def test_sync_writes_once(spark, tmp_path):
    new = spark.createDataFrame([("a/1.md", "一"), ("b.md", "二")], "path string, body string")
    vault = tmp_path / "vault"
    root, note = str(vault), vault / "a" / "1.md"
    names = lambda df: sorted(r["path"] for r in df.collect())
    assert names(NS.sync(new, root)) == ["a/1.md", "b.md"] and NS.read_manifest(spark, root).count() == 2
    assert names(NS.sync(new, root)) == []
    note.write_text(note.read_text().replace(f"{N.USER_BEGIN}\n\n", f"{N.USER_BEGIN}\n手写\n"))
    assert names(NS.sync(new.withColumn("body", F.concat("body", L("改"))), root)) == ["a/1.md", "b.md"]
    assert "手写" in note.read_text() and "一改" in note.read_text()
    (vault / "b.md").unlink()
    assert names(NS.sync(new.withColumn("body", F.concat("body", L("改"))), root)) == ["b.md"]
    more = spark.createDataFrame([("c.md", "三")], "path string, body string")
    assert names(NS.sync(more, root)) == ["c.md"] and NS.read_manifest(spark, root).count() == 3
    assert not any((vault / NS.STAGED).iterdir())


def test_sync_reads_the_places_of_its_notes(spark, tmp_path):
    root = str(tmp_path / "vault")
    rows = [("_drafts/1.md", "一"), (".own/b c%20d.md", "二"), ("c.md", "三")]
    new = spark.createDataFrame(rows, "path string, body string")
    assert NS.sync(new, root).count() == 3
    # Nothing lists the folder, so names that Spark's readers pass over count as well, and other files are not read.
    draft = tmp_path / "vault" / "_drafts" / "1.md"
    draft.write_text(draft.read_text().replace(f"{N.USER_BEGIN}\n\n", f"{N.USER_BEGIN}\n手写\n"))
    assert {r["path"] for r in NS.sync(new, root).collect()} == {"_drafts/1.md"} and "手写" in draft.read_text()
    assert NS.sync(new, root).count() == 0
    asked = spark.createDataFrame([*[(p, 1) for p, _ in rows], ("gone.md", 2)], "path string, n int")
    got = {r["path"]: r for r in NS.with_stored(asked, root, "body").collect()}
    assert got["gone.md"]["body"] is None and got["gone.md"]["n"] == 2 and "二" in got[".own/b c%20d.md"]["body"]


def test_failed_and_interrupted_syncs(spark, tmp_path):
    root = tmp_path / "vault"
    first = spark.createDataFrame([(f"{i}.md", f"t{i}") for i in range(12)], "path string, body string")
    NS.sync(first, str(root))
    before = {p.name: p.read_text() for p in root.glob("*.md")}
    rows = [(f"{i}.md", "other") for i in range(11)] + [("../out.md", "x")]
    with pytest.raises(Exception):  # one task fails: nothing of the others shows
        NS.stage(spark.createDataFrame(rows, "path string, body string").repartition(6), str(root), "bad")
    assert {p.name: p.read_text() for p in root.glob("*.md")} == before and not (root / NS.STAGED / "bad" / NS.COMMITTED).exists()
    # Committed but not put in place, then half put in place: the next sync finishes it.
    NS.stage(spark.createDataFrame(rows[:11], "path string, body string").repartition(3), str(root), "late")
    assert {p.name: p.read_text() for p in root.glob("*.md")} == before
    listed = next((root / NS.STAGED / "late").rglob("list.json"))
    one = json.loads(listed.read_text().splitlines()[0])
    (root / one["staged"]).rename(root / one["path"])
    assert NS.publish(spark, str(root)) == ["late"] and NS.publish(spark, str(root)) == []
    assert sum(p.read_text() == "other" for p in root.glob("*.md")) == 11 and not (tmp_path / "out.md").exists()


def test_library_write_replaces_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "lib")
    df = spark.createDataFrame([(f"b{i}", i) for i in range(40)], "book_id string, v int")
    N.write_library(df, path, buckets=8)
    N.write_library(df.filter("book_id = 'b3'").withColumn("v", L(99)), path, buckets=8)
    rows = {r["book_id"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert rows["b3"] == 99 and len(rows) > 20


def requests(spark, *sources):
    return spark.createDataFrame([(str(i), "p", s) for i, s in enumerate(sources)], "request_id string, prompt_id string, source string")


def test_generation_isolates_failures(spark):
    def fn(prompt, source):
        if source == "late":
            raise G.GenerationError("慢", "model_timeout", timeout_seconds=3)
        if source == "bug":
            raise KeyError("x")
        return " " if source == "blank" else source.upper()

    got = {r["request_id"]: r for r in G.generate(requests(spark, "ok", "late", "bug", "blank"), fn, parallelism=2).collect()}
    assert got["0"]["content"] == "OK" and got["0"]["error_category"] is None
    assert [got[k]["error_category"] for k in "123"] == ["model_timeout", "generation_error", "empty_model_output"]
    assert got["1"]["diagnostics"] == {"timeout_seconds": "3"}


def test_answers_survive_a_failed_job(spark, tmp_path):
    calls, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()
    folder = str(calls)

    def asked(source):
        with open(f"{folder}/{source}", "a") as f:
            f.write("x")

    def dies(prompt, source):
        asked(source)
        if source == "s0":
            time.sleep(12)  # the others are done by then
            os._exit(1)
        if source == "s1":
            raise G.GenerationError("慢", "model_timeout")
        return source.upper()

    def answers(prompt, source):
        asked(source)
        return source.upper()

    rows = requests(spark, *[f"s{i}" for i in range(20)], "s5")  # the last repeats an input
    with pytest.raises(Exception):
        G.generate_once(rows, dies, ledger, parallelism=16).collect()
    stored = {r["content"] for r in G.read_ledger(spark, ledger).where("error_category is null").collect()}
    assert len(stored) >= 8 and "S0" not in stored
    got = {r["request_id"]: r["content"] for r in G.generate_once(rows, answers, ledger, parallelism=16).collect()}
    assert got == {**{str(i): f"S{i}" for i in range(20)}, "20": "S5"}
    count = {f.name: len(f.read_text()) for f in calls.iterdir()}
    assert all(count[s.lower()] == 1 for s in stored)  # what a finished task had stored is not asked again
    assert count["s0"] == 2 and count["s1"] == 2 and sum(count.values()) > 20
    again = G.generate_once(rows, dies, ledger).collect()
    assert len(again) == 21 and {f.name: len(f.read_text()) for f in calls.iterdir()} == count


def test_stages_with_a_match_first(spark, tmp_path):
    artifacts = spark.createDataFrame([("a", "outline", 1, "x")], "episode_id string, stage string, version int, content string")
    episodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "episode_id string")
    due = W.first_missing_stage(episodes, artifacts, episodes.where("episode_id = 'a'"))
    candidates = spark.createDataFrame([(e, k) for e in "bcd" for k in ("k1", "k2")], "episode_id string, card_id string")
    ask = lambda stage: lambda healthy, so_far: healthy.select(F.col("episode_id").alias("request_id"), L(stage).alias("prompt_id"), "episode_id").withColumnRenamed("episode_id", "source")
    told = {"b": '```json\n{"knowledge_item_ids": ["k2", " k2", "k1"]}\n```', "c": '{"knowledge_item_ids": ["k9"]}', "d": "none of them"}
    fn = lambda prompt, source: told[source] if prompt == P.MATCH_STAGE else f"{prompt} {source}"
    made, failed = G.produce_episodes(due, {s: ask(s) for s in (P.MATCH_STAGE, *W.STAGES)}, fn, artifacts, ledger=str(tmp_path / "l"), checks={P.MATCH_STAGE: P.match_check(candidates)}, parallelism=2)
    assert sorted((r["episode_id"], r["stage"]) for r in made.collect()) == [("a", "draft"), ("a", "final"), ("b", "draft"), ("b", "final"), ("b", P.MATCH_STAGE), ("b", "outline")]
    assert sorted((r["episode_id"], r["stage"], r["error"]) for r in failed.collect()) == [("c", P.MATCH_STAGE, "来源匹配返回了所选章节范围之外的知识资产"), ("d", P.MATCH_STAGE, "没有匹配到能够支撑当前声音的知识资产")]
    assert sorted((r["episode_id"], r["card_id"], r["position"]) for r in P.matched_links(made).collect()) == [("b", "k1", 2), ("b", "k2", 1)]


def test_compression_keeps_ids_and_order(spark):
    ids = [f"content_{i:020x}" for i in range(60)]
    source = "\n\n".join(f"{i} " + "正文" * 100 for i in ids)

    def fn(prompt, text):
        assert len(text) <= 5_000
        if len(text) > 1_800:
            raise G.GenerationError("长", "output_truncated")
        return " ".join(w for w in text.split() if w.startswith("content_"))

    r = G.compress(spark.createDataFrame([("k", source)], "key string, text string"), fn).first()
    assert r["error"] is None and r["compressed"].split() == ids
    drop = lambda prompt, text: "无"
    assert G.compress(spark.createDataFrame([("k", source)], "key string, text string"), drop).first()["error"] == "压缩后来源标识不完整"


def test_demo_generator_shapes():
    import json

    data = json.loads(stand_ins.demo_generator("book_analysis", "[content_index: content_0123456789]\n正文"))
    assert data["subtopics"][0]["quotes"][0]["source_content_indexes"] == ["content_0123456789"]
    assert stand_ins.demo_generator("album_outline", "CHAPTER_001 CHAPTER_002 集数：3").count("## 第") == 3


def test_streams_equal_batch(spark, tmp_path):
    """Portions out of order, a restart after each; then a run that falls silent."""
    kinds = ["pending", "running", "failed", "cancelled", None]
    rng = random.Random(8)
    rows = [(f"r{rng.randrange(5)}", i, rng.choice(kinds)) for i in range(200)] + [(None, 200, "running")]
    df = spark.createDataFrame(rows, "run_id string, seq bigint, status string").withColumn("ts", (L(1_704_067_200) + F.col("seq") * 60).cast("timestamp"))
    folder = str(tmp_path / "events")
    seen: list = []

    def keep(batch, batch_id):
        seen.extend((batch_id, r["stale"], r) for r in batch.collect())

    def go(lateness="60 minutes"):
        stream = spark.readStream.schema(df.schema).parquet(folder)
        q = JB.stream_run_state(stream, lateness=lateness).writeStream.outputMode("update").foreachBatch(keep)
        q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    for n in range(6):  # half of each forty minutes comes one portion late
        part = df.filter(F.floor(F.col("seq") / 40) + F.pmod(F.xxhash64("seq"), L(2)) == n)
        part.write.mode("append").parquet(folder)
        go()
        last = {r["run_id"]: r for _, stale, r in sorted((x for x in seen if not x[1]), key=lambda x: x[0])}
        so_far = df.filter(F.floor(F.col("seq") / 40) + F.pmod(F.xxhash64("seq"), L(2)) <= n)
        want = {r["run_id"]: r for r in R.fold_runs(so_far).collect()}
        for k, r in want.items():
            assert all(last[k][c] == r[c] for c in ("status", "attempt", "heartbeat_at", "started_at", "finished_at")), (n, k)
    late = spark.createDataFrame([("r0", 1, "failed"), ("new", 9_000, "pending")], "run_id string, seq bigint, status string").withColumn("ts", (L(1_704_067_200) + F.col("seq") * 60).cast("timestamp"))
    late.write.mode("append").parquet(folder)
    go()
    final = {r["run_id"]: r for _, stale, r in sorted((x for x in seen if not x[1]), key=lambda x: x[0])}
    assert final["r0"]["heartbeat_at"] == want["r0"]["heartbeat_at"]  # far too late: dropped
    silent = {r["run_id"] for _, stale, r in seen if stale}
    assert {k for k, r in want.items() if r["status"] in ("pending", "running")} <= silent


def test_run_status_streamed_in_a_session_that_sets_no_partitions(spark):
    parts = "spark.sql.shuffle.partitions"
    before = spark.conf.get(parts)
    spark.conf.unset(parts)
    try:
        assert entry.queries()["run_status_streamed"](spark, "/root/testdata/sf0.001").count() == 15
        assert spark.conf.get(parts, None) is None  # left as it was
    finally:
        spark.conf.set(parts, before)


def test_library_stream(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    go = lambda: JB.stream_library(spark, str(inbox), out, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    assert JB.delivered(spark, out) == []
    portions = [{"a.md": "# 甲\n正文。又一句。\n## 乙\n下文", "b.txt": "纯文本"}, {"c.md": "# 丙\n别的", "again.md": "# 甲\n正文。又一句。\n## 乙\n下文", "x.pdf": "%PDF"}, {"b2.txt": "纯文本"}]
    for portion in portions:
        for name, text in portion.items():
            (inbox / name).write_text(text)
        go()
    read = lambda name: JB.read_delivered(spark, out, name)
    assert sorted(r["filename"] for r in read("books").collect()) == ["a.md", "b.txt", "c.md"]
    assert sorted(r["title"] for r in read("sections").collect()) == ["b", "丙", "乙", "甲"]
    assert [(r["path"].rsplit("/", 1)[1], r["error"]) for r in read("rejects").collect()] == [("x.pdf", RD.UNSUPPORTED)]
    # The same as reading all files at once, copies left out.
    files = RD.with_suffix(spark.read.format("binaryFile").load(str(inbox))).where("path not like '%again.md' and path not like '%b2.txt'")
    sections = ST.parse_books(RD.read_library(files)[0]).withColumn("status", L("confirmed"))
    want = FR.fragment_records(FR.cut_library(sections), ST.lineage(sections))
    key = lambda df: sorted((r["content_index"], r["book_position"], r["text"]) for r in df.collect())
    assert key(read("fragments")) == key(want) and len(key(want)) == 4
    # A batch that is repeated, with whatever, is not written again; one that failed half-way is.
    done = sorted(JB.delivered(spark, out))
    assert not JB.deliver(files.withColumn("content_hash", L("h")), done[0], out)
    read("sections").limit(1).write.parquet(f"{out}/batches/000000099/sections")
    assert key(read("fragments")) == key(want) and 99 not in JB.delivered(spark, out)
    assert JB.deliver(files.where("path like '%c.md'").withColumn("content_hash", L("h")), 99, out)
    assert len(read("books").collect()) == 4


def test_processor_travels_without_the_package(tmp_path):
    """The worker that reads a state schema beside the driver knows no shipped files."""
    packed = cloudpickle.dumps(JB.RunStateProcessor(1))
    code = "import sys, pickle; print(type(pickle.load(sys.stdin.buffer)).__name__)"
    spark_home = pathlib.Path(cloudpickle.__file__).parents[2]
    got = subprocess.run([sys.executable, "-c", code], input=packed, cwd=tmp_path, env={"PYTHONPATH": str(spark_home)}, capture_output=True, check=False)
    assert got.stdout.decode().strip() == "RunStateProcessor", got.stderr.decode()


def test_compression_of_a_piece_of_dropped_letters(spark):
    """A line cut at half its length can leave one letter over, which the stand-in model drops: no failure."""
    text = "r" + "ab" * 1_000 + "l"
    r = G.compress(spark.createDataFrame([("k", text)], "key string, text string"), shortened).first()
    assert r["error"] is None and re.sub(r"[\srl]+", "", r["compressed"]) == "ab" * 1_000
    assert shortened("p", "rl").strip() and shortened("p", "arl") == "a"
