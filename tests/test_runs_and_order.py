import random
import re

import numpy as np
from pyspark.sql import functions as F

from bindery.operators import evidence as E, fragments as FR, run_fold, runs as R, sets as S, versions as W
from bindery.ordered import assemble, position_block, running
from bindery.plans import prompts as P

EVENT = "run_id string, ts timestamp, seq bigint, status string"


def events(spark, *histories):
    rows = [(f"r{k}", i, s) for k, h in enumerate(histories) for i, s in enumerate(h)]
    df = spark.createDataFrame(rows, "run_id string, seq bigint, status string")
    return df.withColumn("ts", (F.lit(1_704_067_200) + F.col("seq") * 60).cast("timestamp"))


def fold_brute_force(history):
    last, status, attempts = "", "", 0
    for s in history:
        if s == "running" and last == "cancelled":
            continue
        if s == "running":
            attempts += 1
        elif s is not None:
            last = s
        status = s
    return status, attempts


def test_fold_matches_brute_force(spark):
    rng = random.Random(5)
    kinds = ["pending", "running", "failed", "succeeded", "cancelled"]
    histories = [[rng.choice(kinds) for _ in range(rng.randint(1, 120))] for _ in range(40)]
    got = {r["run_id"]: r for r in R.fold_runs(events(spark, *histories)).collect()}
    for k, h in enumerate(histories):
        assert (got[f"r{k}"]["status"], got[f"r{k}"]["attempt"]) == fold_brute_force(h), k
    done = R.fold_runs(events(spark, ["pending", "running", "failed", "running"])).first()
    assert done["status"] == "running" and done["finished_at"] is None and done["attempt"] == 2


def test_fold_of_stretches_is_the_fold_of_the_whole():
    rng = random.Random(3)
    kinds = ["pending", "running", "running", "cancelled", "failed", None]
    codes = {"running": 0, "cancelled": 1, None: 3}

    def summary(h, base):
        _, f = run_fold.summarise(np.zeros(len(h), int), np.arange(base, base + len(h)), np.zeros(len(h), int), np.array([codes.get(k, 2) for k in h], np.int8))
        one = {k: int(v[0]) for k, v in f.items()}
        time = lambda i: base + i if i < len(h) else None
        event = lambda i: {"status": h[i], "at": base + i} if i >= 0 else None
        return {"first": base, "settled": None if one["settled"] < 0 else bool(one["cancelled"]), "free_n": one["free_n"], "free_at": time(one["free_at"]),
                "sure_n": one["sure_n"], "sure_at": time(one["sure_at"]), "open": event(one["open"]), "shut": event(one["shut"])}

    for _ in range(400):
        h = [rng.choice(kinds) for _ in range(rng.randint(3, 14))]
        i, j = sorted(rng.sample(range(1, len(h)), 2))
        a, b, c = summary(h[:i], 0), summary(h[i:j], i), summary(h[j:], j)
        whole = summary(h, 0)
        assert run_fold.compose(run_fold.compose(a, b), c) == whole == run_fold.compose(a, run_fold.compose(b, c)), h


def test_fold_of_a_hot_run(spark):
    rng = random.Random(6)
    kinds = ["pending", "running", "running", "cancelled", "failed", None]
    rows = [("hot" if i % 2 else f"r{i % 40}", i // 3, i, rng.choice(kinds)) for i in range(8_000)] + [(None, 5, 1, "running"), (None, 6, 1, "cancelled"), ("lone", None, 3, "running")]
    df = spark.createDataFrame(rows, "run_id string, us bigint, seq bigint, status string").withColumn("ts", F.timestamp_micros("us"))
    parts = run_fold.stretches(df.select("run_id", F.col("us").alias("at"), "seq", "status").repartitionByRange(8, "run_id", "at", "seq", "status").sortWithinPartitions("run_id", "at", "seq", "status"))
    assert parts.where("run_id = 'hot'").count() > 3  # it is cut by count
    got = {r["run_id"]: (r["status"], r["attempt"]) for r in R.fold_runs(df).collect()}
    by: dict = {}
    for k, us, seq, status in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        by.setdefault(k, []).append(status)
    assert got == {k: fold_brute_force(h) for k, h in by.items()}
    assert R.fold_runs(df.limit(0)).count() == 0
    plan = R.fold_runs(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("rangepartitioning") == 1


def test_running_crosses_blocks_for_a_hot_key(spark):
    # One key holds a third of the rows; blocks are far smaller than the key.
    rows = [("hot" if i % 3 == 0 else f"k{i % 700}", i, i % 5, None if i % 4 else i) for i in range(6_000)]
    rows += [(None, i, 1, i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, pos bigint, v int, m bigint").repartition(6)
    got = running(df, ["k"], ["pos"], position_block(F.col("pos"), 64), number="n", sums={"s": F.col("v")}, before={"b": F.col("m")})
    seen: dict = {}
    for k, pos, v, m in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        n, s, b = seen.get(k, (0, 0, None))
        seen[k] = (n + 1, s + v, m if m is not None else b)
        seen.setdefault("rows", {})[(k, pos)] = (n + 1, s + v, b)
    assert {(r["k"], r["pos"]): (r["n"], r["s"], r["b"]) for r in got.collect()} == seen["rows"]


def test_assemble_keeps_order(spark):
    df = spark.createDataFrame([("k", i * 1000, f"l{i}") for i in range(5000)], "k string, pos bigint, t string").repartition(5)
    assert assemble(df, ["k"], ["pos"], F.col("t")).first()["text"] == "\n".join(f"l{i}" for i in range(5000))


def test_set_versions(spark):
    rows = [("b", 1, "x"), ("b", 2, "x"), ("b", 3, "y"), ("b", 4, "x"), ("c", 1, None), ("c", 2, None)]
    df = spark.createDataFrame(rows, "book string, at bigint, content_fingerprint string")
    got = [(r["version"], r["status"]) for r in FR.version_on_change(df, "book", "at", position_block(F.col("at"), 2)).orderBy("book", "at").collect()]
    assert got[:4] == [(1, "historical"), (1, "historical"), (2, "historical"), (3, "current")]


def batch(spark, states):
    rows = [(f"c{i}", "p", f"e{i}", i, s) for i, s in enumerate(states)]
    return spark.createDataFrame(rows, "run_id string, parent_run_id string, episode_id string, created_at int, status string")


def test_batch_with_one_failure_then_reconciled(spark):
    children = batch(spark, ["succeeded"] * 6 + ["failed"])
    out = R.batch_outcome(children).first()
    assert (out["batch_status"], out["project_status"], out["message"]) == ("partial_failed", "partial_failed", "6 条完成，1 条失败")
    assert R.batch_summary(children).first()["percent"] == 86
    later = spark.createDataFrame([("e6",)], "episode_id string")
    fixed = R.batch_outcome(R.reconcile(children, later)).first()
    assert (fixed["batch_status"], fixed["message"]) == ("succeeded", "7 条声音终稿已生成")
    assert R.batch_outcome(batch(spark, ["succeeded", "cancelled"])).first()["project_status"] == "ready"


def test_cancel_cascade(spark):
    children = batch(spark, ["pending", "running", "succeeded"])
    gone = spark.createDataFrame([("p",)], "run_id string")
    state = lambda b: [r["status"] for r in R.cancel_cascade(children, gone, batch=b).orderBy("run_id").collect()]
    assert state(True) == ["cancelled", "running", "succeeded"] and state(False) == ["cancelled", "cancelled", "succeeded"]


def test_eligible_and_first_stage(spark):
    episodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "episode_id string")
    artifacts = spark.createDataFrame([("a", "final", 1), ("b", "outline", 2), ("b", "draft", 1)], "episode_id string, stage string, version int")
    runs = spark.createDataFrame([("episode", "c", "running"), ("episode", "d", "failed")], "scope_type string, scope_id string, status string")
    assert sorted(r[0] for r in E.eligible_episodes(episodes, artifacts, runs).collect()) == ["b", "d"]
    linked = spark.createDataFrame([("b",)], "episode_id string")
    got = {r["episode_id"]: (r["from_stage"], r["target_stages"]) for r in W.first_missing_stage(episodes, artifacts, linked).collect()}
    assert got["b"] == ("final", ["final"]) and got["d"] == ("outline", ["match_episode_sources", "outline", "draft", "final"])


def test_module_recovery(spark):
    modules = spark.createDataFrame(
        [("p", "new", 2, "m1", ["a", "b"]), ("p", "new", 2, "m2", ["a", "b", "c"]), ("p", "new", 2, "m3", ["c", "d"]), ("p", "old", 1, "m4", ["e"]), ("p", "new", 2, "m5", ["x", "y"]), ("p", "new", 2, "m6", ["x", "z", "y"])],
        "project_id string, run_id string, run_at int, module_key string, chapters array<string>",
    )
    episodes = spark.createDataFrame(
        [("p", "exact", ["b", "a"]), ("p", "inside", ["d"]), ("p", "older", ["e"]), ("p", "nothing", ["q"]), ("p", "both", ["a"]), ("p", "pair", ["y"])], "project_id string, episode_id string, chapters array<string>"
    )
    got = {r["episode_id"]: (r["outcome"], r["module_key"]) for r in E.recover_module(episodes, modules).collect()}
    assert got == {
        "exact": ("recovered", "m1"), "inside": ("recovered", "m3"), "older": ("recovered", "m4"), "nothing": ("none", None), "both": ("ambiguous", None), "pair": ("ambiguous", None),
    }


def test_module_recovery_matches_brute_force(spark):
    rng = random.Random(12)
    pick = lambda top: sorted(rng.sample("abcdefgh", rng.randint(1, top)))
    modules = [(f"p{rng.randrange(3)}", f"r{r}", r, f"m{i}", pick(6)) for i in range(400) for r in [rng.randrange(4)]]
    episodes = [(f"p{rng.randrange(4)}", f"e{i}", pick(3) * 2) for i in range(150)] + [("p0", "empty", [])]
    want = {}
    for p, e, c in episodes:
        runs = {}
        for mp, run, at, key, have in modules:
            if mp == p and c and set(c) <= set(have):
                runs.setdefault((at, run), []).append((key, set(have) == set(c)))
        if runs:
            best = max(runs)
            hits = [k for k, exact in runs[best] if exact] or [k for k, _ in runs[best]]
            want[e] = (best[1], hits[0] if len(hits) == 1 else None, "recovered" if len(hits) == 1 else "ambiguous")
        else:
            want[e] = (None, None, "none")
    got = E.recover_module(
        spark.createDataFrame(episodes, "project_id string, episode_id string, chapters array<string>"),
        spark.createDataFrame(modules, "project_id string, run_id string, run_at int, module_key string, chapters array<string>"),
    )
    assert {r["episode_id"]: (r["run_id"], r["module_key"], r["outcome"]) for r in got.collect()} == want


def test_neighbours_stay_in_section_and_skip_direct(spark):
    members = spark.createDataFrame([(f"f{i}", 1, i, 0 if i < 4 else 1) for i in range(8)], "content_index string, set_id int, book_position bigint, section int")
    direct = members.filter("content_index in ('f2', 'f3', 'f6')").withColumn("episode_id", F.lit("e"))
    got = {r["content_index"] for r in E.auxiliary_context(direct, members, "section").collect()}
    assert got == {"f1", "f5", "f7"}


def test_evidence_bundles(spark):
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    episodes = frame(
        [("two", [], ["b"]), ("alone", [], ["b"]), ("stale", [], ["b"]), ("bare", [], ["b"]), ("nothing", [], ["b"]), ("gone", ["x"], ["b"]), ("chapter", ["root"], ["b"]), ("legacy", ["s2", "s1"], ["b"]), ("foreign", ["t1"], ["b"]), ("null", None, ["b"])],
        "episode_id string, source_section_ids array<string>, book_ids array<string>",
    )
    links = frame([("two", "k2", 2), ("two", "k1", 1), ("alone", "k3", 1), ("stale", "k1", 1), ("stale", "old", 2), ("bare", "k1", 1), ("bare", "un", 2)], "episode_id string, card_id string, position int")
    cards = frame([(k, "观点", f"T{k}", f"B{k}", "superseded" if k == "old" else "active", E.EVIDENCE_SCHEME) for k in ("k1", "k2", "k3", "old", "un")], "card_id string, kind string, title string, body string, status string, source_scheme string")
    sources = frame([("k1", "f2", 1), ("k2", "f3", 1), ("k2", "f2", 2), ("k3", "g1", 1), ("un", "h1", 1), ("old", "f2", 1)], "card_id string, content_index string, source_order int")
    members = frame([("now", f"f{i}", i, ["章", f"节{i}"]) for i in range(1, 6)] + [("now", "g1", 9, ["乙"]), ("past", "h1", 1, ["旧"])], "set_id string, content_index string, book_position int, section_path array<string>")
    sets = frame([("now", "current"), ("past", "historical")], "set_id string, status string")
    fragments = frame([(f"f{i}", "b", "s1" if i < 4 else "s2", f"文{i}") for i in range(1, 6)] + [("g1", "b", "s3", "文g"), ("h1", "b", "s1", "文h")], "content_index string, book_id string, source_section_id string, text string")
    sections = frame([("root", "b", None, 0, "章", "全"), ("s1", "b", "root", 1, "一", "甲"), ("s2", "b", "root", 2, "二", "乙"), ("t1", "c", "t0", 1, "他", "丙")], "section_id string, book_id string, parent_id string, position int, title string, content string")
    got = {r["episode_id"]: (r["error"], r["evidence"]) for r in E.evidence_bundles(episodes, links, cards, sources, members, sets, fragments, sections, frame([("b",), ("b",)], "book_id string")).collect()}
    assert {k: v[0] for k, v in got.items() if v[0]} == {
        "stale": E.STALE_CARDS, "bare": "知识资产“Tun”缺少当前版本原文证据", "nothing": E.NO_SOURCES, "null": E.NO_SOURCES, "gone": E.SOURCES_GONE, "chapter": E.NOT_MATCHED, "foreign": E.FOREIGN_SOURCES,
    }
    # The cards by position, what they cite in reading order, and what lies around within the section (f1, not f4).
    assert got["two"][1] == (
        f"{E.ASSETS_HEAD}\n## [k1] 观点 · Tk1\nBk1\n证据索引：f2\n\n## [k2] 观点 · Tk2\nBk2\n证据索引：f3, f2\n\n"
        f"{E.DIRECT_HEAD}\n## 直接证据 [f2]\n章节路径：章 / 节2\n文2\n\n## 直接证据 [f3]\n章节路径：章 / 节3\n文3\n\n"
        f"{E.AUXILIARY_HEAD}\n## 辅助上下文 [f1]\n章节路径：章 / 节1\n文1"
    )
    assert got["alone"][1].endswith(f"文g\n\n{E.AUXILIARY_HEAD}\n无")
    assert got["legacy"][1] == "## 原文块 [s1] 一\n甲\n\n## 原文块 [s2] 二\n乙"


def test_reused_and_missing(spark):
    links = spark.createDataFrame([("e1", "a"), ("e1", "a"), ("e2", "b"), ("e3", "b")], "e string, c string")
    assert [r[0] for r in S.reused_assets(links, "e", "c").collect()] == ["b"]


def test_prompt_scope_precedence(spark):
    templates = spark.createDataFrame([(1, "s", 10, 11), (2, "t", 20, None)], "template_id int, stage_key string, system_version_id int, global_version_id int")
    versions = spark.createDataFrame([(10, 1, "sys"), (11, 2, "glob"), (12, 3, "proj"), (20, 1, "sys2")], "version_id int, version int, user_template string")
    projects = spark.createDataFrame([("p", [1, 2]), ("q", [1, 2])], "project_id string, template_ids array<int>")
    bindings = spark.createDataFrame([("p", 1, 12)], "project_id string, template_id int, active_version_id int")
    got = {(r["project_id"], r["template_id"]): (r["user_template"], r["source_label"]) for r in W.effective_prompt(projects, templates, versions, bindings).collect()}
    assert got == {("p", 1): ("proj", "项目 v3"), ("q", 1): ("glob", "全局 v2"), ("p", 2): ("sys2", "系统默认"), ("q", 2): ("sys2", "系统默认")}


def bundle_of(spark, links, extra_members=()):
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    members = [("s1", f"f{i}", i, ["章", f"节{i // 4}"]) for i in range(1, 9)] + list(extra_members)
    return E.evidence_bundles(
        frame([("e", ["x"], ["b"])], "episode_id string, source_section_ids array<string>, book_ids array<string>"), frame(links, "episode_id string, card_id string, position int"),
        frame([(c, "观点", f"题{c}", "体", "active", E.EVIDENCE_SCHEME) for c in "ab"], "card_id string, kind string, title string, body string, status string, source_scheme string"),
        frame([("a", "f2", 1), ("a", "f3", 2), ("b", "f3", 1), ("b", "f6", 2)], "card_id string, content_index string, source_order int"),
        frame(members, "set_id string, content_index string, book_position int, section_path array<string>"),
        frame([("s1", "current"), ("s0", "historical")], "set_id string, status string"),
        frame([(f"f{i}", "b", f"n{i // 4}", f"文{i}") for i in range(1, 9)], "content_index string, book_id string, source_section_id string, text string"),
        frame([("x", "b", None, 1, "t", "c")], "section_id string, book_id string, parent_id string, position int, title string, content string"), frame([("b",)], "book_id string"),
    )


def test_fragments_of_a_bundle_are_shuffled_once(spark):
    """Cards that share fragments, an older set, neighbours within a section; texts do not travel where the dimension is small."""
    r = bundle_of(spark, [("e", "a", 1), ("e", "b", 2)], [("s0", "f2", 7, ["旧"]), ("s0", "f1", 6, ["旧"])])
    text = r.first()["evidence"]
    assert [x.split("]")[0] for x in text.split("## 直接证据 [")[1:]] == ["f2", "f3", "f6"] and "旧" not in text.split(E.AUXILIARY_HEAD)[0]
    # f4 follows f3, but in another section.
    assert [x.split("]")[0] for x in text.split("## 辅助上下文 [")[1:]] == ["f1", "f5", "f7"]
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(episode_id#\d+, content_index#", plan)


def test_contexts_of_several_stages_join_evidence_once(spark):
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    episodes = frame([("e", "题", " 框架 ", "书", "", True, 300, 500, "模块"), ("f", "题", " ", "书", "作者", False, 300, 500, None)], "episode_id string, title string, content_framework string, book_title string, book_author string, narrative boolean, words_min int, words_max int, module_analysis string")
    evidence = frame([("e", "证据", None), ("f", None, "因由")], "episode_id string, evidence string, error string")
    previous, people = frame([("f", "上集")], "episode_id string, previous_final string"), frame([("e", "甲与乙")], "episode_id string, relations string")
    stages = {"outline": frame([], "episode_id string, content string"), "draft": frame([("e", "细纲")], "episode_id string, content string"), "final": frame([("f", "初稿")], "episode_id string, content string")}
    both = P.episode_contexts(episodes, stages, evidence, previous, people)
    got = sorted(map(str, both.collect()))
    assert got == sorted(str(r) for k, v in stages.items() for r in P.episode_context(episodes, k, evidence, previous, v, people).collect()) and len(got) == 6
    assert {(r["episode_id"], r["stage"]): r["error"] for r in both.collect()}[("e", "final")] == "缺少上一步产物：声音初稿"
