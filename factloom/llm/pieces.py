"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

Reading a text once, the automaton's state is the longest suffix that some piece begins with; its output links list every
piece that ends here, longest first, and each relaxes the best score of this position. A character that no piece of one
character covers costs the smallest score less 10 and is written as the byte pieces of its UTF-8 form. Of equal scores the
path with the longest last piece stays, as in the public unigram encoder.

A space is written as U+2581 and one more stands before the text. Where no piece holds U+2581 after another character
(checked when the model is read), the best path of a text is those of its stretches from space to space, so each task
encodes its distinct stretches only, all of them side by side, one character position at a time. Otherwise a text is one
stretch. Equal stretches are found by a hash and compared in full; the query decodes every text again and compares.

Defined cases: a null text has null ids, an empty one no ids; a U+2581 of the text itself is written in bytes, so that
decoding returns it; unknown ids decode to nothing; repeated rows stay; further columns are carried along, but for one
named like the added column, which is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from factloom.llm.common import binaries, packed, run_hashes, slices, small_batches

#: Fixed by the public format: the sign for a space, the penalty of an unknown character, and the kinds of pieces.
SPACE_SIGN, UNKNOWN_PENALTY, NORMAL, USER, BYTE = "▁", 10.0, 1, 4, 6
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    """The pieces of a model: what is shipped to the tasks (its size is that of the vocabulary)."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]


def read_vocabulary(path: str = DEFAULT_MODEL) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return Vocabulary(tuple(p.piece for p in model.pieces), tuple(p.score for p in model.pieces), tuple(p.type for p in model.pieces))


class Automaton:
    """Goto, failure and output links in arrays; states are numbered breadth first from 0, the root."""

    def __init__(self, words: list[tuple[str, int, float]]):
        children: list[dict[str, int]] = [{}]
        piece, score, length = [-1], [0.0], [0]
        for word, number, value in words:
            at = 0
            for c in word:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    piece.append(-1)
                    score.append(0.0)
                    length.append(0)
                at = children[at][c]
            piece[at], score[at], length[at] = number, value, len(word)
        fail, out = [0] * len(children), [-1] * len(children)
        queue = list(children[0].values())
        for at in queue:
            for c, to in children[at].items():
                back = fail[at]
                while back and c not in children[back]:
                    back = fail[back]
                fail[to] = children[back].get(c, 0)
                queue.append(to)
            out[at] = fail[at] if piece[fail[at]] >= 0 else out[fail[at]]
        keys = np.array([(at << 21) | ord(c) for at, m in enumerate(children) for c in m], np.int64)
        to = np.array([x for m in children for x in m.values()], np.int32)
        order = np.argsort(keys)
        self.piece, self.score, self.length = np.array(piece, np.int32), np.array(score), np.array(length, np.int32)
        self.fail, self.out = np.array(fail, np.int32), np.array(out, np.int32)
        self.keys, self.to = keys[order], to[order]
        bits = max(8, int(len(keys) * 8).bit_length())
        self.shift = np.uint64(64 - bits)
        self._fill(bits)

    def _fill(self, bits: int) -> None:
        """An open-addressed table of the goto edges."""
        size = 1 << bits
        self.slot_key, self.slot_to = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        left, slot, self.probes = np.arange(len(self.keys)), self._slot(self.keys), 0
        while len(left):
            free = self.slot_key[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            first = first[free[first]]
            self.slot_key[slot[first]], self.slot_to[slot[first]] = self.keys[left[first]], self.to[left[first]]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, slot = left[rest], (slot[rest] + 1) & (size - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _goto(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The edge's end, or -1."""
        key = (state.astype(np.int64) << 21) | char
        slot = self._slot(key)
        found = np.where(self.slot_key[slot] == key, self.slot_to[slot], -1)
        todo = np.flatnonzero((found < 0) & (self.slot_key[slot] >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.slot_key) - 1)
            held = self.slot_key[slot[todo]]
            hit = held == key[todo]
            found[todo[hit]] = self.slot_to[slot[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return found

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        to = self._goto(state, char)
        todo = np.flatnonzero((to < 0) & (state > 0))
        back = state[todo]
        while len(todo):
            back = self.fail[back]
            found = self._goto(back, char[todo])
            to[todo] = found
            more = (found < 0) & (back > 0)
            todo, back = todo[more], back[more]
        return np.maximum(to, 0)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        words = [(p, i, s) for i, (p, s, k) in enumerate(zip(v.pieces, v.scores, v.kinds, strict=True)) if k in (NORMAL, USER) and p]
        normal = [s for s, k in zip(v.scores, v.kinds, strict=True) if k == NORMAL]
        self.unknown = min(normal, default=0.0) - UNKNOWN_PENALTY
        self.automaton = Automaton(words)
        self.by_space = all(SPACE_SIGN not in p.lstrip(SPACE_SIGN) for p, _, _ in words)
        self.byte_ids = np.zeros(256, np.int32)
        out = []
        for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)):
            if k == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
            out.append(bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE_SIGN, " ").encode() if k in (NORMAL, USER) else b"")
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.out_offs = np.r_[0, np.cumsum([len(x) for x in out])]

    # ---- encoding

    def viterbi(self, chars: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of each stretch's best path, one stretch after the other, and how many each has.

        ``chars``: code points of all stretches; a space is already U+2581, one that the text has itself is 0x10FFFF + 1.
        """
        a, n = self.automaton, len(start)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        # position 0 of each stretch, then one for each of its characters
        base = np.cumsum(length + 1) - (length + 1)
        best = np.full(int((length + 1).sum()), -np.inf)
        back = np.zeros(len(best), np.int32)
        best[base] = 0.0
        state = np.zeros(n, np.int32)
        ends = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")  # stretches longer than t
        for t, m in enumerate(ends):
            state = a.step(state[:m], chars[start[:m] + t])
            at = base[:m] + t + 1
            # a character alone, unless a piece of one character is found below
            top, who = np.full(m, -np.inf), np.full(m, -1, np.int32)
            node = np.where(a.piece[state] >= 0, state, a.out[state])
            live = np.flatnonzero(node >= 0)
            node, single = node[live], np.zeros(m, bool)
            while len(live):
                size = a.length[node]
                score = best[at[live] - size] + a.score[node]
                better = score > top[live]
                top[live[better]], who[live[better]] = score[better], node[better]
                single[live[size == 1]] = True
                node = a.out[node]
                more = node >= 0
                live, node = live[more], node[more]
            score = best[at - 1] + self.unknown
            better = ~single & (score > top)
            top[better], who[better] = score[better], -1
            best[at], back[at] = top, who
        # back from the ends, all stretches at once
        pos, live, parts = length.copy(), np.flatnonzero(length > 0), []
        step = 0
        while len(live):
            node = back[base[live] + pos[live]]
            unknown = node < 0
            size = np.where(unknown, 1, a.length[node])
            if unknown.any():
                who = live[unknown]
                chars_ = chars[start[who] + pos[who] - 1]
                raw = [SPACE_SIGN.encode() if c > 0x10FFFF else b" " if c == ord(SPACE_SIGN) else chr(c).encode() for c in chars_.tolist()]
                width = np.array([len(x) for x in raw])
                place = step + np.repeat(width, width) - 1 - (np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width))
                parts.append((np.repeat(who, width), place, self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]))
            known = live[~unknown]
            parts.append((known, np.full(len(known), step), a.piece[node[~unknown]]))
            pos[live] -= size
            live = live[pos[live] > 0]
            step += 4
        who = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.int64)])
        place = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)])
        ids = np.concatenate([p[2] for p in parts] or [np.zeros(0, np.int32)])
        who = order[who]
        final = np.lexsort((-place, who))
        return ids[final].astype(np.int32), np.bincount(who, minlength=n)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, and where each text's begin (with the end last), of texts as UTF-8 bytes."""
        n = len(offs) - 1
        full = np.flatnonzero(np.diff(offs))
        cut = np.zeros(len(data) + 1, bool)
        if self.by_space and len(data):
            gap = data == 0x20
            cut[: len(data)] = gap
            cut[1 : len(data)] &= ~gap[:-1]
        first = np.zeros(len(data) + 1, bool)
        first[offs[:-1][full]] = True
        s = np.flatnonzero((cut | first)[: len(data)])
        if not len(s):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        e = np.r_[s[1:], len(data)]
        head = first[s]
        h = run_hashes(data, s, e) ^ head.astype(np.uint64)
        _, example, which = np.unique(h, return_index=True, return_inverse=True)
        # a stretch is compared with the one that stands for its hash; one that differs stands for itself
        like = example[which]
        odd = (e - s != (e - s)[like]) | (head != head[like])
        shift = np.where(odd, 0, s[like] - s)
        odd |= np.logical_or.reduceat(data != data[np.arange(len(data)) + np.repeat(shift, e - s)], s)
        which[odd] = len(example) + np.arange(odd.sum())
        example = np.r_[example, np.flatnonzero(odd)]
        s1, e1, head1 = s[example], e[example], head[example]
        size = e1 - s1
        flat = data[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(s1, size)]
        chars = np.frombuffer(flat.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        counts = np.add.reduceat(((flat & 0xC0) != 0x80).astype(np.int64), np.cumsum(size) - size)
        chars[chars == ord(SPACE_SIGN)] = 0x110000
        chars[chars == 0x20] = ord(SPACE_SIGN)
        begin = np.cumsum(counts) - counts
        chars = np.insert(chars, begin[head1], ord(SPACE_SIGN))  # the space that stands before each text
        counts = counts + head1
        ids, each = self.viterbi(chars, np.cumsum(counts) - counts, counts)
        at = np.cumsum(each) - each
        n_ids = each[which]
        out = ids[np.arange(n_ids.sum()) - np.repeat(np.cumsum(n_ids) - n_ids, n_ids) + np.repeat(at[which], n_ids)]
        row = np.searchsorted(offs, s, "right") - 1
        per_row = np.bincount(row, n_ids, minlength=n).astype(np.int64)
        return out, np.r_[0, np.cumsum(per_row)]

    # ---- decoding

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and where each begins, of their ids; the space before each text is taken off."""
        ids = np.where((ids >= 0) & (ids < len(self.out_offs) - 1), ids, 0)
        size = np.diff(self.out_offs)[ids]
        data = self.out_bytes[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.out_offs[:-1][ids], size)]
        bounds = np.r_[0, np.cumsum(size)][offs]
        lead = bounds[:-1][np.diff(bounds) > 0]
        lead = lead[data[lead] == 0x20]
        keep = np.ones(len(data), bool)
        keep[lead] = False
        return data[keep], np.r_[0, np.cumsum(keep)][bounds]


@lru_cache(maxsize=2)
def encoder(vocabulary: Vocabulary) -> Encoder:
    return Encoder(vocabulary)


def _with(docs: DataFrame, name: str, kind) -> StructType:
    return StructType([f for f in docs.schema.fields if f.name != name] + [StructField(name, kind)])


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with an array of piece ids."""
    schema = _with(docs, into, ArrayType(IntegerType()))

    def each(batches):
        own = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, text):
                column = part.column(text)
                ids, offs = own.encode(*packed(column))
                values = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids), mask=column.is_null())
                names = [n for n in part.schema.names if n != into]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], values], [*names, into])

    return small_batches(docs).mapInArrow(each, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; bytes that are no UTF-8 become U+FFFD."""
    schema = _with(encoded, into, StringType())

    def each(batches):
        own = encoder(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                column = part.column(ids)
                offs = np.r_[0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
                data, bounds = own.decode(column.flatten().fill_null(0).to_numpy(zero_copy_only=False), offs)
                values = binaries(data, bounds)
                try:
                    values = values.cast(pa.string())
                except pa.ArrowInvalid:
                    values = pa.array([x.as_py().decode("utf-8", "replace") for x in values], pa.string())
                values = pa.compute.if_else(column.is_null(), pa.scalar(None, pa.string()), values)
                names = [n for n in part.schema.names if n != into]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], values], [*names, into])

    import pyarrow.compute  # noqa: F401

    return small_batches(encoded).mapInArrow(each, schema)


def op4_sentencepiece(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    v = read_vocabulary()
    out = decode(encode(docs, v), v)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"))
