"""Exact copies, n-gram join, personal data, toxicity."""

import hashlib
import itertools
import random
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

import plain
from bindery.llm import exact_dedup, graph, ngram_join, pii, rows, toxicity
from bindery.llm.flat import text_slices
from bindery.session import ship_code


@pytest.fixture(scope="module")
def docs_of(spark):
    ship_code(spark)
    return lambda data, schema="doc_id bigint, text string": spark.createDataFrame(data, schema)


MANY = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 100_000), (8, "X" * 100_000), (9, "x" * 99_999 + "y"), (10, "alone"), (10, "alone"), (None, "ABC"), (None, "nobody")]


def test_exact_groups(docs_of):
    want, by = {}, {}
    for k, t in MANY:
        by.setdefault((t or "").translate(plain.FOLD), []).append(k)
    for t, ids in by.items():
        keep = max((k for k in ids if k is not None), default=None)
        for k in set(ids):
            want[(k, hashlib.sha256(t.encode()).hexdigest())] = (keep, len(ids), k == keep)
    got = exact_dedup.exact_groups(docs_of(MANY), hash_all=True).collect()
    assert len(got) == len(want)
    assert {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in got} == want
    tiny = exact_dedup.exact_groups(docs_of(MANY), hash_all=True, bits=1 << 15).collect()  # a crowded map changes nothing
    assert sorted(map(str, tiny)) == sorted(map(str, got))


def test_exact_copies_go(docs_of):
    data = [(k, t, i, f"{i}") for i, (k, t) in enumerate(MANY)]
    got = exact_dedup.drop_exact_copies(docs_of(data, "doc_id bigint, text string, _row int, kept string"))
    assert got.columns == ["doc_id", "text", "_row", "kept"]
    rows_ = got.collect()
    assert sorted((r.doc_id or 0) for r in rows_) == [0, 2, 4, 5, 6, 8, 9, 10]
    assert all(r.kept == str(r._row) for r in rows_)
    assert exact_dedup.drop_exact_copies(docs_of([])).count() == 0 == exact_dedup.exact_groups(docs_of([])).count()


def test_exact_runs_no_python(docs_of):
    plan = exact_dedup.exact_groups(docs_of(MANY))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_membership_map(spark):
    few, all_ = spark.range(0, 1000, 7), spark.range(1000)
    got = rows.mark_members(all_, all_.id, few, few.id, "there").collect()
    assert all(r.there for r in got if r.id % 7 == 0) and sum(r.there for r in got) < 200
    assert not any(r.there for r in rows.mark_members(all_, all_.id, few.limit(0), few.id, "there").collect())


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (6, 6), (None, 1), (7, 8), (8, 7), (10, 9), (9, 11), (11, 12), (12, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys([1, 2, 3, 9, 10, 11, 12], 1), 4: 4, 5: 4, 7: 7, 8: 7}


def near_copies(seed=3, groups=12):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(words) for _ in range(60)]
    out = []
    for _ in range(groups):
        base = [rnd.choice(words) for _ in range(rnd.choice([4, 5, 7, 30, 120, 300]))]
        for _ in range(rnd.randint(1, 9)):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(own) // 25))):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            out.append(" ".join(own).upper() if rnd.random() < 0.2 else "\n".join(own))
        out.append(" ".join([*passage, *(rnd.choice(words) for _ in range(rnd.randint(1, 200)))]))
    out += ["", None, "  \t", "one", "one", "ONE two", passage and " ".join(passage), " ".join(passage) + " tail", "long " * 3 + " ".join(rnd.choice(words) for _ in range(30_000))]
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("universe,pivots", [(0.4, 16), (0.05, 1), (1.0, 2)])
def test_ngram_join(docs_of, universe, pivots):
    data = near_copies()
    want, sizes = plain.components(data)
    got = ngram_join.join_components(docs_of(data), universe=universe, pivots=pivots).collect()
    assert len(got) == len(data)
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == {k: (want[k], sizes[k]) for k in want}


def unlinked_lists():
    """Two documents at exactly 0.8 whose lists are led by over 16 others, no two of which link."""
    common = [f"h{i}" for i in range(10)]
    pairs = [" ".join(["g1", "g2", *common[:6], last]) for last in ("h6", "h7")]
    combos = list(itertools.combinations(common, 6))
    fillers = [" ".join(["g1", *c]) for c in combos[:150]] + [" ".join(["g2", *c]) for c in combos[-160:]]
    return list(enumerate(pairs + fillers))


@pytest.mark.parametrize("copies", [0, 2])
def test_links_do_not_depend_on_other_rows(docs_of, copies):
    data = unlinked_lists()
    data += [(1_000 + i, " ".join(f"u{j}" for j in range(20 + i))) for i in range(copies)]
    got = {r.doc_id: r.component_id for r in ngram_join.join_components(docs_of(data), size=1, universe=1.0).collect()}
    assert got[0] == got[1] == 0
    assert all(got[i] == i for i in range(2, 312))
    assert {got[1_000 + i] for i in range(copies)} <= {1_000}


def test_ngram_join_edges(docs_of):
    assert ngram_join.join_components(docs_of([])).count() == 0
    assert {r.component_id for r in ngram_join.join_components(docs_of([(3, None), (4, "")])).collect()} == {3, 4}
    text = "a b c d e f g h i j k l"
    data = [(None, text, 1), (5, text.upper(), 2), (4, text, 3), (4, text, 4), (6, "other words are in this one here", 5), (None, "", 6)]
    docs = docs_of(data, "doc_id bigint, text string, c int")
    got = ngram_join.join_components(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles) for r in got) == [(0, 0, 0), (0, 4, 8), (4, 4, 8), (4, 4, 8), (5, 4, 8), (6, 6, 3)]
    left = ngram_join.drop_near_copies(docs)
    assert left.columns == ["doc_id", "text", "c"]
    assert sorted(r.c for r in left.collect()) == [1, 3, 4, 5, 6]  # rows of an id that stays all stay


def test_base_spans():
    rnd = random.Random(5)
    parts = ["a", "@", "b.", ".", " ", "-", "+", "(", ")", "1", "23", "456", "00000255", "256", "4111111111111111", "é", "٣", "%", "@a.b", "+1 (017) 555-7713"]
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 16)))
        assert pii.base_spans(text) == plain.personal(text), text


def test_contexts_find_the_unseen(docs_of):
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "340000000000009 ", "6011000990139424", "3530111333300000"]
    data = [(i, f"please charge card number {c} at once") for i, c in enumerate(cards)]
    data += [(50, "please charge card number 4111111111111112 at once"), (51, "the year 20240101 was long"), (52, None), (None, "mail é x@y.org"), (52, "4111111111111111"), (52, "4111111111111111")]
    got = pii.find(docs_of(data))
    found = {(r.doc_id, tuple((s.start, s.kind, s.end) for s in r.more)) for r in got.collect() if r.more}
    assert found == {(50, ((26, 2, 42),))}
    assert got.count() == len(data)
    more = {(r.doc_id, r.text) for r in pii.redact(docs_of(data)).collect()}
    assert (50, "please charge card number [CARD] at once") in more and (None, "mail é [EMAIL]") in more and (52, None) in more
    assert pii.find(docs_of([])).count() == 0 == pii.redact(docs_of([])).count()


def test_candidates_next_to_many_spans():
    text = " ".join(f"a{i}@b.cd id{i:06d} or 10.0.0.{i % 256}" for i in range(3000))
    spans = pii.base_spans(text)
    assert len(spans) == 6000
    start = time.process_time()
    found = [(s, e) for s, e, k, *_ in pii.candidates(text, spans) if k < 0]
    assert time.process_time() - start < 2
    assert len(found) == 3000 and all(text[s:e].startswith("id") for s, e in found)


def test_marks_take_a_byte_for_a_byte():
    column = pa.array(["no mark here " * 200, "", "one 1 ", None, "x@y"] * 5_000)  # 13 MB
    tracemalloc.start()
    got = [lo + i for lo, _, data, offsets in text_slices(column) for i in pii.marked(data, offsets).tolist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [5 * i + j for i in range(5_000) for j in (2, 4)]
    assert peak < 8 << 20
    data, offsets = np.frombuffer(b"ab1", np.uint8), np.array([0, 0, 2, 2, 3, 3])
    assert pii.marked(data, offsets).tolist() == [3] and pii.marked(data[:0], np.zeros(3, int)).tolist() == []


def test_redaction_keeps_columns(docs_of):
    docs = docs_of([(1, "a +1 (017) 555-7713 b", 21, "x"), (2, None, None, "y"), (3, "", 0, None)], "doc_id bigint, text string, n_chars bigint, more string")
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[1].text == "a [PHONE] b" and got[1].n_chars == 11 and got[1].more == "x"
    assert got[2].text is None and got[2].n_chars is None and got[3].text == ""


def toxic_rows(n=900):
    rnd = random.Random(1)
    bad = [f"foul{i}" for i in range(8)]
    data, labels = [], []
    for i in range(n):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(5, 120))]
        toxic = rnd.random() < 0.2
        if toxic:
            for _ in range(rnd.randint(1, 4)):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad) + rnd.choice(["", "!", "..."]))
        data.append((i, " ".join(words), rnd.choice(["en", "de", None])))
        labels.append((i, int(toxic)))
    return data, labels


def test_toxicity_on_held_out_rows(docs_of):
    data, labels = toxic_rows()
    docs = docs_of([*data, (9_000, None, "en"), (9_001, "", None), (9_002, "w1 " * 80_000 + "foul1 foul2", "en")], "doc_id bigint, text string, lang string")
    model = toxicity.train(docs, docs_of([*labels, (None, 1), (5, None), (77_777, 1)], "doc_id bigint, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(data) + 3 and all(0 <= r.score <= 1 for r in got.values())
    held = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = np.mean([(got[i].score >= 0.5) == bool(t) for i, t in held])
    assert right > 0.95
    assert got[9_000].score == got[9_001].score < 0.5 < got[9_002].score  # the end of a long text counts
    assert toxicity.drop_toxic(docs, model).count() == sum(not r.toxic for r in got.values())


def test_toxicity_without_labels(docs_of):
    docs = docs_of([(1, "a", "en")], "doc_id bigint, text string, lang string")
    for labels in ([], [(1, 1)], [(2, 0)]):
        model = toxicity.train(docs, docs_of(labels, "doc_id bigint, toxic int"))
        assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0]
    assert toxicity.score(docs.limit(0), toxicity.Model()).count() == 0 and toxicity.drop_toxic(docs, toxicity.Model()).count() == 1


def test_toxicity_of_repeated_ids_and_no_language(docs_of):
    data, labels = toxic_rows(300)
    rows_ = [(i, t) for i, t, _ in data]
    hot = next(i for i, t in labels if t and zlib.crc32(str(i).encode()) % 5)
    docs, marks = docs_of(rows_ + [(hot, rows_[hot][1])] * 500), docs_of(labels, "doc_id bigint, toxic int")
    model = toxicity.train(docs, marks)
    once = toxicity.train(docs_of(rows_), marks)
    assert np.array_equal(model.tables, once.tables) and model.out_bias == once.out_bias and set(model.by_language) <= {""}
    assert toxicity.score(docs, model).count() == 800 and toxicity.drop_toxic(docs, model).count() < 800
    small = toxicity.train(docs, marks, sample_total=50)  # few texts fit, or none
    assert toxicity.score(docs, small).count() == 800


def test_toxicity_never_reads_the_language(docs_of):
    data, labels = toxic_rows(300)
    schema = "doc_id bigint, text string, lang string"
    model = toxicity.train(docs_of(data, schema), docs_of(labels, "doc_id bigint, toxic int"))
    score = lambda rows_: sorted((r.doc_id, r.score) for r in toxicity.score(docs_of(rows_, schema), model).collect())
    assert score(data) == score([(i, t, "xx") for i, t, _ in data])


def test_toxicity_is_fitted_on_every_labelled_row(docs_of, monkeypatch):
    long = "w1 w2 w3 " * 22_000  # 66,000 words
    data = [(i, long + "foul" if i % 2 else "w1 w2 w3 nice") for i in range(24)]
    model = toxicity.train(docs_of(data), docs_of([(i, i % 2) for i, _ in data], "doc_id bigint, toxic int"))
    assert not model.empty
    # Dealt to many copies of the model: every text is counted, and twice the same model comes out.
    data, labels = toxic_rows()
    docs, marks = docs_of(data, "doc_id bigint, text string, lang string"), docs_of(labels, "doc_id bigint, toxic int")
    counted = toxicity._bucket_counts(docs_of([(False, "a b a"), (True, "a"), (True, "a c"), (True, None)], "toxic boolean, text string"))
    assert sorted(counted[0][counted[0] > 0]) == sorted(counted[1][counted[1] > 0]) == [1, 1, 1, 2]
    monkeypatch.setattr(toxicity, "PER_COPY", 100)
    model, again = toxicity.train(docs, marks), toxicity.train(docs.repartition(5), marks)
    assert np.array_equal(model.tables, again.tables) and model.out_bias == again.out_bias
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]) > 0.95


def test_toxicity_moves_few_texts_without_label(docs_of):
    docs = docs_of([(i, "a") for i in range(5000)], "doc_id bigint, text string")
    known = docs_of([(i,) for i in range(0, 5000, 10)], "doc_id bigint")
    left = {r.doc_id for r in toxicity._perhaps_labelled(docs, known, 500).collect()}
    assert left >= set(range(0, 5000, 10)) and len(left) < 1000
    # Ids of other types hash to other places, so nothing is dropped.
    assert toxicity._perhaps_labelled(docs, known.selectExpr("cast(doc_id AS int)"), 500).count() == 5000
