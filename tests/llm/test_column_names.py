"""Columns of any name come through everything that carries columns."""

from factloom.llm import exact_dedup, importance, mixing, near_dedup, passages
from factloom.llm.common import packed_others, unpacked

NAMES = ["_", "a.b", "c`d", "__", "_others", "doc", "_digest", "kept", "x y", "_text"]


def frame(spark):
    words = [" ".join(f"w{(i * 7 + j) % 50}" for j in range(30)) for i in range(12)]
    rows = [(i, words[i % 9], "ab"[i % 2], *[f"{n}{i}" for n in NAMES]) for i in range(12)]
    quoted = ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES)
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {quoted}"), rows


def test_names_survive_packing(spark):
    docs, rows = frame(spark)
    assert sorted(map(tuple, unpacked(packed_others(docs, "doc_id", "text"), docs.columns).collect())) == sorted(rows)
    assert packed_others(docs.select("doc_id"), "doc_id").count() == 12


def test_names_survive_operators(spark):
    docs, rows = frame(spark)
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    for out in (exact_dedup.keep_first(docs), near_dedup.near_dedup(docs), mixing.mixed(docs), importance.keep_sampled(docs, labels)):
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.collect()} <= set(rows)
    assert {r["doc_id"] for r in exact_dedup.keep_first(docs).collect()} == set(range(9))
    plain = exact_dedup.content_sort(docs)
    assert {"a.b", "_", "c`d"} <= set(plain.columns) and plain.count() == 12
    removed = near_dedup.near_rows(docs).where("false").selectExpr("doc_id", "digest")
    assert removed.count() == 0 and hasattr(passages, "without")
