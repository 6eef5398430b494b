"""SentencePiece coding (4): against the public library's unigram encoder, brute force and exact round trips."""

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as pb

from factloom.llm import pieces
from factloom.llm.common import packed


@pytest.fixture(scope="module")
def vocabulary():
    v = pieces.read_vocabulary()
    # the library adds up scores in single precision; pieces that are out of use have scores too large for that
    return pieces.Vocabulary(v.pieces, tuple(max(x, -40_000.0) for x in v.scores), v.kinds)


@pytest.fixture(scope="module")
def library():
    model = pb.ModelProto()
    with open(pieces.DEFAULT_MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        p.score = max(p.score, -40_000.0)
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def coded(vocabulary, texts):
    e = pieces.encoder(vocabulary)
    ids, offs = e.encode(*packed(pa.array(texts, pa.string())))
    data, bounds = e.decode(ids, offs)
    return [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)], [data[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


ODD = ["", " ", "   ", "  lead", "trail  ", "a  b", "\n\t x", "日本語 テキスト", "😀 x😀😀", "Ünï ßcode", "x" * 3000, "a b", "\x00"]


def test_equals_the_library_and_round_trips(spark, vocabulary, library):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ODD
    ids, back = coded(vocabulary, texts)
    score = lambda x: sum(vocabulary.scores[i] for i in x)
    for t, own in zip(texts, ids, strict=True):
        want = library.encode(t)
        assert own == want or score(own) == pytest.approx(score(want)), t
    assert back == texts


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_text_round_trips(texts):
    assert coded(pieces.read_vocabulary(), texts)[1] == texts


def test_the_sign_for_a_space_survives():
    ids, back = coded(pieces.read_vocabulary(), ["a▁b ▁ c"])
    assert back == ["a▁b ▁ c"]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text("abc▁", min_size=1, max_size=4), st.integers(-30, -1), max_size=12), st.text("abcd ", max_size=12))
def test_best_path_of_any_vocabulary(words, text):
    """Pieces with U+2581 inside make a text one stretch; the score is that of trying every segmentation."""
    v = pieces.Vocabulary(("<unk>", *[f"<0x{b:02X}>" for b in range(256)], *words), (0.0, *[0.0] * 256, *map(float, words.values())), (2, *[6] * 256, *[1] * len(words)))
    ids, back = coded(v, [text])
    assert back == [text]
    # undo the byte form, then add up: each unknown character costs the same
    full = ("▁" + text.replace(" ", "▁")) if text else ""
    unknown = min(words.values(), default=0) - pieces.UNKNOWN_PENALTY
    best = [0.0] + [float("-inf")] * len(full)
    for i in range(1, len(full) + 1):
        for j in range(i):
            s = words.get(full[j:i], unknown if i - j == 1 else None)
            if s is not None:
                best[i] = max(best[i], best[j] + s)
    got, raw = 0.0, b""
    for i in ids[0]:
        if i > 256:
            got += v.scores[i]
        else:
            raw += bytes([i - 1])
    got += unknown * len(raw.decode().replace("▁", " "))
    assert got == pytest.approx(best[-1])


def test_on_spark(spark):
    v = pieces.read_vocabulary()
    docs = spark.createDataFrame([(1, "Hello world", "old", 5), (1, "Hello world", "old", 5), (2, None, None, None), (3, "", "x", 1)], "doc_id long, text string, ids string, n int")
    out = pieces.decode(pieces.encode(docs, v), v)
    got = sorted(out.collect(), key=lambda r: r["doc_id"])
    assert [r["decoded"] for r in got] == ["Hello world", "Hello world", None, ""]
    assert got[2]["ids"] is None and got[3]["ids"] == [] and set(out.columns) == {"doc_id", "text", "n", "ids", "decoded"}
    assert pieces.encode(spark.createDataFrame([], docs.schema), v).count() == 0


def test_stretches_that_share_a_hash_are_coded_apart(vocabulary, monkeypatch):
    """Doubled words, and a hash that says nothing at all."""
    x, y = "ab", "ba"
    while len(x) < 1024:
        x, y = x + y, y + x
    texts = [x, y, f"{x} {y}", "one two", "two one ", ""]
    want = coded(vocabulary, texts)
    assert want[1] == texts
    monkeypatch.setattr(pieces, "run_hashes", lambda data, s, e: (s * 0).astype("uint64"))
    assert coded(vocabulary, texts) == want
