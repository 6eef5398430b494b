"""Commits to the note table replace what their paths hold, are read at once, and leave other partitions' files alone."""

from pathlib import Path

from factloom.operators import notes
from factloom.sources import note_store

NOTE = "path string, heading string, ord int, text string"


def held(spark, store):
    return sorted(tuple(r) for r in note_store.read(spark, store).collect())


def test_append_delete_and_view_over_commits(spark, tmp_path):
    store = str(tmp_path / "notes")
    assert held(spark, store) == []
    rows = [(f"/src/{i}.c", f"f{h}", 0, f"text {i} {h}") for i in range(40) for h in range(2)]
    first = spark.createDataFrame(rows, NOTE)
    note_store.commit(store, first.select("path"), first)
    assert held(spark, store) == sorted(rows)
    # append to one path
    own = note_store.read(spark, store).where("path = '/src/3.c'")
    more = notes.append(own, spark.createDataFrame([("/src/3.c", "f1", "more")], "path string, heading string, text string"))
    before = {p: p.stat().st_mtime_ns for p in Path(store).rglob("*.parquet")}
    note_store.commit(store, more.select("path"), more)
    want = sorted([*rows, ("/src/3.c", "f1", 1, "more")])
    assert held(spark, store) == want
    assert notes.view(note_store.read(spark, store), spark.createDataFrame([("/src/3.c", "f1")], "path string, heading string")).first()["body"] == "text 3 1\nmore"
    after = {p: p.stat().st_mtime_ns for p in Path(store).rglob("*.parquet")}
    assert len({p.parent for p in before if after.get(p) != before[p]}) == 1  # one partition alone was written
    # delete one heading, then every note of another path
    own = note_store.read(spark, store).where("path = '/src/3.c'")
    note_store.commit(store, own.select("path"), notes.delete(own, spark.createDataFrame([("/src/3.c", "f0")], "path string, heading string")))
    note_store.commit(store, spark.createDataFrame([("/src/5.c",)], "path string"), first)  # given again: as it was
    note_store.commit(store, spark.createDataFrame([("/src/7.c",), (None,), ("/src/7.c",), ("/new.c",)], "path string"), first.limit(0))
    want = [r for r in want if r[0] != "/src/7.c" and r[:2] != ("/src/3.c", "f0")]
    assert held(spark, store) == want


def test_the_last_note_of_a_partition_goes(spark, tmp_path):
    store = str(tmp_path / "one")
    note = spark.createDataFrame([("a", "f", 0, "x"), ("a", None, 0, "y"), (None, "f", 0, "z")], NOTE)
    note_store.commit(store, note.select("path"), note, buckets=1)
    assert held(spark, store) == [("a", "f", 0, "x")]
    note_store.commit(store, note.select("path"), note.limit(0), buckets=1)
    assert held(spark, store) == []
    note_store.commit(store, note.select("path").limit(0), note, buckets=1)  # names nothing
    assert held(spark, store) == []
