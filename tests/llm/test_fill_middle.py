"""Fill-in-the-middle against a plain version, text by text."""

import hashlib
import re

from factloom.llm import fill_middle


def plainly(doc_id, text, fim=100, spm=50):
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return len(lines), "plain", None, None, None, text
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    return (len(lines), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(lines), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


TEXTS = ["", None, "a", "a\nb", "a\nb\n", "\n\n\n", "x<P>y\nz", "<\nP>\n<", "a<S", "ü é\r\nb\x85c\n𝕏\n", "<M>", "q\n" * 5000, "w" * 200_000, " \n\t\n", "<P\n><S\n>"]


def test_fill_in_middle_against_plain_version(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(8 * len(TEXTS))] + [(None, "a\nb\nc"), (-3, "a\nb\nc"), (5, "k\nl\nm"), (5, "k\nl\nm")]
    docs = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], "doc_id long, text string, form string, `a.b` int, `_h` int")
    for fim, spm in ((100, 50), (40, 0), (0, 50)):
        out = fill_middle.formatted(docs, fim, spm)
        got = [tuple(r[:7]) for r in out.collect()]
        assert sorted(got, key=repr) == sorted(((i, *plainly(i, t, fim, spm)) for i, t in rows), key=repr)
        assert {tuple(r.others) for r in out.collect()} == {("clash", 1, 2)}
        back = out.select("doc_id", fill_middle.restored(out["output"], out["form"]).alias("t")).collect()
        assert sorted((tuple(r) for r in back), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert {f for f, *_ in {(r.form, 0) for r in fill_middle.formatted(docs).collect()}} == {"plain", "psm", "spm"}


def test_fill_in_middle_empty_table(spark):
    assert fill_middle.formatted(spark.createDataFrame([], "doc_id long, text string")).collect() == []
