"""Source mixing (1), importance resampling (2), chat formatting (5), quality rules (8) and the pipeline."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import chat, importance, mixing, quality_rules

SF = "/root/testdata/sf0.001"


# ---- 1


def level(sizes, share=1.5, cap=2.0):
    """Targets by repeated sharing of the excess."""
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    total, target, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(target[i] for i in range(len(sizes)) if i not in open_)
        for i in open_:
            target[i] = left * weights[i] / sum(weights[j] for j in open_)
        above = {i for i in open_ if target[i] > cap * sizes[i]}
        for i in above:
            target[i] = cap * sizes[i]
        if not above:
            break
        open_ -= above
    return target


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 300)), "abcd"[int(rng.integers(0, 4)) % (1 + i % 4)]) for i in range(3000)] + [(9000 + i, "x y", None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.cube_mix(docs, group_rows=100).collect()
    again = mixing.cube_mix(docs.repartition(7), group_rows=100).collect()
    assert {(r["doc_id"], r["copies"]) for r in got} == {(r["doc_id"], r["copies"]) for r in again}
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = dict(zip(order, level([sizes[s] for s in order]), strict=True))
    for s in order:
        own = [r for r in got if r["source"] == s]
        assert own[0]["source_size"] == sizes[s] and own[0]["target"] == pytest.approx(want[s])
        assert sum(r["taken"] for r in own) == pytest.approx(want[s], rel=0.01, abs=4)
        assert all(r["taken"] <= 2 * r["size"] for r in own)


def test_mix_defined_cases(spark):
    schema = "doc_id long, text string, source string, size string, target int"
    assert mixing.cube_mix(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(1, None, None, "s", 1), (None, "", "a", "s", 1), (2, "a b", "a", "s", 1), (2, "a b", "a", "s", 1), (2, "c", "a", "t", 2)], schema)
    got = mixing.cube_mix(docs).collect()
    assert len(got) == 5 and sum(r["size"] for r in got) == 5
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)


def test_flight_keeps_totals():
    rng = np.random.default_rng(5)
    p, size = rng.random(200), rng.integers(0, 90, 200)
    q = mixing.flight(p, size)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum()) and (q * size).sum() == pytest.approx((p * size).sum())


# ---- 2


def test_the_sample_is_the_largest_keys(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = importance.resample(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    kept = [r["key"] for r in rows if r["kept"]]
    assert 0 < len(kept) < len(rows) == docs.count() and min(kept) > max(r["key"] for r in rows if not r["kept"])


def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0)
    got = importance.resample(docs, seen)
    own = labels.join(seen, "doc_id", "left_anti").join(got.select("doc_id", "kept"), "doc_id").collect()
    clean = [r["kept"] for r in own if r["quality"] == 1 and r["toxic"] == 0]
    junk = [r["kept"] for r in own if r["quality"] == 0]
    assert np.mean(clean) > 0.99 and np.mean(junk) < 0.1


def test_weights_equal_brute_force(spark):
    texts = ["a b c", "a  b", None, "", "c c c c d e f g h i j k"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = importance.count_models(docs, np.array([0, 3]), 997).collect()
    ratios = importance.log_ratios(counts, 997, 2.0)

    def buckets(text):
        import pyarrow as pa

        return [b.tolist() for b, _ in importance.ngram_buckets(pa.array([text], pa.string()), 997)]

    raw, own = np.zeros(3 * 997), np.zeros(3 * 997)
    for i, t in enumerate(texts):
        w = (t or "").split()
        assert [len(b) for b in buckets(t)] == [len(w), max(0, len(w) - 1), max(0, len(t or "") - 2)]
        for b in buckets(t):
            np.add.at(raw, b, 1)
            if i in (0, 3):
                np.add.at(own, b, 1)
    for k in range(3):
        at = slice(k * 997, k * 997 + 997)
        p = (raw[at] + 1) / (raw[at] + 1).sum()
        assert ratios[at] == pytest.approx(np.log((own[at] + 2 * 997 * p) / (own[at].sum() + 2 * 997) / p))
    for r in importance.weigh(docs, ratios, 4, ["doc_id", "text"]).collect():
        assert r["log_weight"] == pytest.approx(sum(ratios[b].sum() for b in buckets(r["text"])))
        assert r["score"] == pytest.approx(sum(ratios[b].mean() * 4 * math.tanh(len(b) / 4) for b in buckets(r["text"]) if b))


def test_kth_largest_is_exact(spark):
    rng = np.random.default_rng(2)
    keys = [*rng.normal(0, 50, 500).tolist(), 0.0, -0.0, 1.5, 1.5, 1.5, -1e300, 1e-300]
    df = spark.createDataFrame([(k,) for k in keys], "key double")
    for k in (1, 2, 250, len(keys)):
        assert importance.kth_largest(df, k) == sorted(keys, reverse=True)[k - 1]


def test_classifier_defined_cases(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, "y"), (2, "", None)], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert importance.resample(docs, labels).where("kept").count() == 4
    assert importance.keep_sampled(docs, labels).columns == docs.columns
    assert importance.resample(spark.createDataFrame([], docs.schema), labels).count() == 0


# ---- 5


def test_spans_of_a_black_box():
    messages = [("user", "a</turn>"), ("assistant", "\\### x"), ("user", ""), ("assistant", "ä")]
    found = chat.locate(chat.marked_turns, messages)
    assert [chat.unescape(found.formatted[s:e]) for s, e in found.texts] == [t for _, t in messages]
    assert "".join(found.formatted[s:e] for s, e in found.turns) == found.formatted
    assert chat.read_back(found.formatted) == messages
    many = [("user" if k % 2 else "assistant", f"t{k}") for k in range(200)]
    assert chat.read_back(chat.locate(chat.marked_turns, many).formatted) == many


def test_a_role_that_the_template_leaves_out():
    quiet = lambda ms: "".join(f"<{r}>{t};" for r, t in ms if r != "system")
    found = chat.locate(quiet, [("system", "be good"), ("user", "hi"), ("system", "again"), ("assistant", "yo")])
    assert not found.rewrites_history
    assert [found.formatted[s:e] for s, e in found.texts] == ["", "hi", "", "yo"]
    assert found.turns == [(0, 0), (0, 9), (9, 9), (9, len(found.formatted))]


def test_rewritten_history_is_found():
    newest_first = lambda ms: "".join(f"<{r}>{t}" for r, t in reversed(ms))
    last_bare = lambda ms: "".join(f"<{r}>{'' if k < len(ms) - 1 else 'now '}{t}" for k, (r, t) in enumerate(ms))
    for render in (newest_first, last_bare):
        assert chat.locate(render, [("user", "one"), ("assistant", "two")]).rewrites_history


def test_chat_defined_cases(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string"
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", None, "x"), (None, None, None, "t", None), (1, 1, "assistant", None, "x")]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(spark.createDataFrame(rows, schema))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 0 and got[None]["n_turns"] == 1


# ---- 8


def test_statistics_equal_brute_force(spark):
    texts = ["a b c a b c x", "Über! #tag\n\nÜber! #tag\nx", None, "", " \n ", "a a a a a", "one two", " x y"] + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    got = {r["doc_id"]: r for r in quality_rules.statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        inside = {k + d for k, x in enumerate(windows) if windows.count(x) > 1 for d in range(3)} if len(w) < 3000 else None
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        assert inside is None or r["n_repeat_words"] == len(inside)
    failed = {r["doc_id"]: r["f"] for r in quality_rules.statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).withColumn("f", quality_rules.base_failed()).collect()}
    assert failed == {i: r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"] for i, r in got.items()}


def test_rules_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen = labels.where("doc_id % 2 = 0")
    rules = quality_rules.fit(docs, seen)
    assert rules and all(c.feature in quality_rules.FEATURES for rule in rules for c in rule)
    own = quality_rules.statistics(docs.join(labels.where("doc_id % 2 = 1"), "doc_id").select("doc_id", "text")).withColumn("ok", quality_rules.verdict(rules)).join(labels, "doc_id").collect()
    assert np.mean([r["ok"] for r in own if r["quality"] == 1]) > 0.97
    assert np.mean([r["ok"] for r in own if r["quality"] == 0]) < 0.5


def test_rules_defined_cases(spark):
    docs = spark.createDataFrame([(1, "w " * 60, "x"), (None, None, "y"), (1, "w v", None)], "doc_id long, text string, kept string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_rules.quality_rules(docs, none).collect()
    assert sorted((r["n_words"], r["kept"]) for r in got) == [(0, False), (2, False), (60, False)]
    assert quality_rules.quality_rules(spark.createDataFrame([], docs.schema), none).count() == 0
    assert not math.isnan(quality_rules._gain(1, 0, 1, 1))


# ---- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r["doc_id"] for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        rows = out.collect()
        assert rows and {r["doc_id"] for r in rows} <= ids
        docs = out if k < 4 else docs
    assert all(r["round_trip"] for r in rows)


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls anywhere, empty and long texts, repeated rows, clashing names, and no rows at all."""
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, key string, size string, copies string, _others string, id string"
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "some text here", "en", "a"), (1, "some text here", "en", "a"), (2, "", None, "a"), (None, None, None, None), (3, long, "en", None), (4, long + " x", "en", "b"), (5, "some  text here", None, "b")]
    docs = spark.createDataFrame([(*r, 1, "k", "y", "s", "c", "o", "i") for r in rows], schema)
    for some in (docs, docs.where("false")):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, some, str(tmp_path))
            found = out.collect()
            if k < 4:
                assert out.columns == docs.columns
                assert all(r["kept"] == "k" and r["_others"] == "o" and r["copies"] == "c" for r in found)
                want = {0: 7, 1: 4, 2: None, 3: None}[k] if some is docs else 0
                assert want is None or len(found) == want
            if some is not docs:
                assert not found
    assert near_kept(corpus_pipeline, spark, docs) == {1, 2, 3, None}  # 5 has the words of 1


def near_kept(corpus_pipeline, spark, docs):
    return {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
