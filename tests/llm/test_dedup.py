"""Exact dedup (9) and suffix-array dedup (10) against brute force."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import exact_dedup, suffix_dedup

DOCS = "doc_id long, text string, lang string, kept string"


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup_equals_brute_force(spark):
    texts = ["a  b", "a b", "a\tb", "", None, " ", "é é", "é\n é", "x" * 100_000, "x" * 100_000, "x" * 99_999 + "y"] + ["hot text"] * 50
    rows = [(i, t, "l", "mine") for i, t in enumerate(texts)]
    out = exact_dedup.content_sort(spark.createDataFrame(rows, DOCS), hot_share=0.05)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(normal(t), []).append(i)
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows) and "lang" in out.columns
    for i, t, *_ in rows:
        g = groups[normal(t)]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(g), len(g), min(g) == i)
        assert got[i]["text_sha256"] == hashlib.sha256(normal(t).encode()).hexdigest()


def test_exact_dedup_defined_cases(spark):
    assert exact_dedup.content_sort(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "t", "l", "k"), (None, "t", "l", "k"), (3, "t", "l", "k"), (3, "t", "m", "k"), (None, "alone", "l", "k")]
    got = exact_dedup.content_sort(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"] or -1, r["kept"]) for r in got) == [(-1, False), (-1, False), (-1, True), (3, False), (3, True)]


# ---- suffixes


def brute_force(rows, length):
    """n_bytes, removed positions of (doc_id, text) rows."""
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            s, d = b[i : i + length], float("inf") if doc is None else doc
            first[s] = min(first.get(s, float("inf")), d)
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (float("inf") if doc is None else doc):
                gone[i : i + length] = True
        out.append((doc, len(b), gone))
    return out


def spans(gone):
    edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def check(spark, rows, length, **how):
    docs = spark.createDataFrame([(d, t, "l", "mine") for d, t in rows], DOCS)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    got = sorted(((r["doc_id"], r["n_bytes"], [(x["start"], x["end"]) for x in r["spans"]], bytes(r["kept"])) for r in suffix_dedup.suffix_dedup(docs, length=length, **how).collect()), key=key)
    want = sorted(((d, n, spans(g), bytes(np.frombuffer((t or "").encode(), np.uint8)[~g])) for (d, n, g), (_, t) in zip(brute_force(rows, length), rows, strict=True)), key=key)
    assert got == want


def test_suffix_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(d), "".join(rng.choice(["the ", "cat é", "sat on ", "a ", "mat. "], rng.integers(0, 60)))) for d in rng.permutation(40)]
    passage = "one passage that many of the documents share, whatever stands around it in them; "
    rows += [(100 + k, f"{k}" * k + passage * (1 + k % 2) + f"{k * 7}" * 9) for k in range(12)]
    rows += [(200, "z" * 3000), (201, "z" * 2000), (150, rows[3][1]), (151, rows[3][1])]
    for length in (12, 50):
        check(spark, rows, length, block_bytes=700)


def test_suffix_dedup_defined_cases(spark):
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], DOCS)).count() == 0
    long = "a text of more than fifty bytes that several of these rows have in common."
    check(spark, [(None, long), (None, long + "x"), (5, long), (5, long), (5, "y" + long), (7, None), (8, ""), (9, "short"), (4, "é" * 60)], 50)
    with pytest.raises(ValueError, match="at least"):
        suffix_dedup.suffix_dedup(spark.createDataFrame([], DOCS), length=3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=12, max_size=30), min_size=1, max_size=12))
def test_suffixes_of_a_bucket_are_in_order(texts):
    """The difference cover resolves ties of any length: compare with sorting the suffixes themselves."""
    texts = list(dict.fromkeys(texts))
    size = np.array([len(t) for t in texts])
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    matrix = suffix_dedup._wide(data, np.cumsum(size) - size, size, int(size.max()))
    n = size - 9
    sa, flat = suffix_dedup.sort_suffixes(matrix, n)
    suffixes = [texts[p // matrix.shape[1]][p % matrix.shape[1] :] for p in sa]
    assert suffixes == sorted(t[o:] for t, m in zip(texts, n, strict=True) for o in range(m))
    same = suffix_dedup.same_prefix(sa, flat, 10)
    assert same.tolist() == [i > 0 and suffixes[i][:10] == suffixes[i - 1][:10] for i in range(len(sa))]


def test_long_data_is_worked_through_in_chunks():
    rng = np.random.default_rng(3)
    data, offs = rng.integers(97, 100, 5000).astype(np.uint8), np.array([0, 1200, 1230, 1230, 5000])
    whole = suffix_dedup.minimizer_runs(data, offs, 50)
    parts = suffix_dedup.minimizer_runs(data, offs, 50, chunk=333)
    each = lambda r: {(int(s) + i, int(v)) for s, n, v in zip(*r[:3], strict=True) for i in range(n)}
    assert each(whole) == each(parts)
    assert {p for p, _ in each(whole)} == set(range(1151)) | set(range(1230, 4951))


def test_exact_dedup_carries_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a  b", 1, 2, 3, 4), (2, "a b", 5, 6, 7, 8)], "doc_id long, text string, _head int, _norm int, _size int, _salt int")
    out = exact_dedup.content_sort(docs)
    assert sorted((r["doc_id"], r["_head"], r["_norm"], r["_size"], r["_salt"], r["kept"]) for r in out.collect()) == [(1, 1, 2, 3, 4, True), (2, 5, 6, 7, 8, False)]


def test_suffixes_of_a_frequent_minimizer(spark, monkeypatch):
    from factloom.llm import screen

    rng = np.random.default_rng(8)
    phrase = "a phrase of more than twenty-four bytes; "
    rows = [(i, " ".join(f"{x}" for x in rng.integers(0, 9, rng.integers(4, 12))) + phrase * (1 + i % 3) + " ".join(f"{x}" for x in rng.integers(0, 9, 12))) for i in range(60)]
    known = screen.Known.frequent
    seen = []
    monkeypatch.setattr(screen, "FREQUENT", 0)
    monkeypatch.setattr(screen.Known, "frequent", lambda self, t: seen.append(known(self, t).sum()) or np.ones(len(t), bool))
    check(spark, [*rows, (2**63 - 1, rows[3][1]), (None, rows[4][1])], 50, block_bytes=1500)
