"""Near-equal units (paragraphs, lines) of texts: from whole texts to the occurrences that go.

A unit is known by a hash of its shingle set, so equal sets are one item. A first pass over the texts (``screen``) finds
which signature bands occur twice or more; only units with such a band, and their own text, go on. Signatures of the
distinct ones meet under their bands, candidates are verified on their full shingle sets, and verified links are joined
by union-find. Of each component the occurrence with the smallest (identifier, place) stays.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import near, screen
from factloom.llm.common import binaries, cut, drop, order_within, packed, packed_others, settle, slices, unpacked
from factloom.llm.near_dedup import set_ids, with_digest

#: Texts are worked on in slices of about so many bytes, whose arrays stay in the processor's caches.
SLICE = 1 << 18


@dataclass
class Units:
    """The units of some texts: the text's row, the unit's place in it, its bytes [start, end), and its shingle hashes."""

    row: np.ndarray
    place: np.ndarray
    start: np.ndarray
    end: np.ndarray
    h: np.ndarray
    bounds: np.ndarray

    def distinct_sets(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of each unit."""
        unit = np.repeat(np.arange(len(self.row)), np.diff(self.bounds))
        h = self.h[order_within(self.h, self.bounds)]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (unit[1:] != unit[:-1])
        return h[new], np.searchsorted(unit[new], np.arange(len(self.row) + 1))

    def take(self, keep: np.ndarray) -> Units:
        unit = np.repeat(keep, np.diff(self.bounds))
        return Units(self.row[keep], self.place[keep], self.start[keep], self.end[keep], self.h[unit], np.r_[0, np.cumsum(np.diff(self.bounds)[keep])])


@dataclass(frozen=True)
class Kind:
    """How units are cut and compared. ``cut``: UTF-8 bytes of texts and where each begins -> Units; ``sets``: a column of units'
    bytes -> their sets, for verification; ``sign``: hashes and bounds -> a matrix of signatures' bytes; ``form``: see near."""

    cut: Callable
    sets: Callable
    sign: Callable
    form: near.Form


def tuned_bands(similarity: float, recall: float, rows: int) -> int:
    """The fewest bands of ``rows`` coordinates that let a pair of this similarity meet with this probability at least."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))


#: What tells the first of several occurrences: null identifiers come last.
PLACE = ["late", "doc_id", "digest", "start", "end", "place"]
_FOUND = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("place", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("id", pa.int64()), ("sig", pa.binary())])


def candidates(docs: DataFrame, kind: Kind, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, digest, place, start, end, id and sig of every unit that shares a band with another one, written once."""
    blocks, n = screen.blocks_of(docs, block_bytes)
    buckets = max(8, n // 4)

    def tokens_of(texts: pa.Table, _known: screen.Known) -> np.ndarray:
        out = []
        for part in slices(texts, "text", SLICE):
            u = kind.cut(*packed(part.column("text")))
            out.append(kind.form.tokens(kind.sign(u.h, u.bounds)).ravel())
        return np.concatenate(out)

    def found(texts: pa.Table, side: pa.Table) -> pa.Table:
        if not texts.num_rows or not side.num_rows:
            return _FOUND.empty_table()
        known = screen.Known(side, buckets)
        parts = [found_in(part, known) for part in slices(screen.in_order(texts), "text", SLICE)]
        return pa.concat_tables([x for x in parts if x is not None] or [_FOUND.empty_table()])

    def found_in(texts: pa.Table, known: screen.Known) -> pa.Table | None:
        data, offs = packed(texts.column("text"))
        u = kind.cut(data, offs)
        sig = kind.sign(u.h, u.bounds)
        keep = known(kind.form.tokens(sig).ravel()).reshape(len(sig), -1).any(axis=1)
        if not keep.any():
            return None
        u, sig = u.take(keep), sig[keep]
        first = offs[u.row]
        row = pa.array(u.row)
        return pa.table(
            [texts.column("doc_id").take(row), texts.column("digest").take(row), pa.array(u.place), pa.array(u.start - first), pa.array(u.end - first), pa.array(set_ids(*u.distinct_sets())), binaries(sig.ravel(), np.arange(len(sig) + 1) * sig.shape[1])],
            schema=_FOUND,
        )

    empty = blocks.sparkSession.createDataFrame([], screen.SIDE)
    shared = screen.shared_fingerprints(blocks, empty, tokens_of, buckets)
    return settle(screen.met(blocks, shared, found, "doc_id long, digest long, place long, start long, end long, id long, sig binary"))


def place() -> "F.Column":
    return F.struct(F.col("doc_id").isNull().alias("late"), *PLACE[1:])


def distinct_units(found: DataFrame) -> DataFrame:
    """id, n (occurrences), first (the place of the first one) and sig; written once."""
    return settle(found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(place()).alias("first"), F.first("sig").alias("sig")))


def unsigned(units: DataFrame) -> DataFrame:
    """The settled ``units`` without their signatures, once these have served; the wide form is removed."""
    narrow = settle(units.drop("sig"))
    drop(units)
    return narrow


def close_units(distinct: DataFrame, kind: Kind, item_rows: int = 8192, list_rows: int = 1024) -> DataFrame:
    """id, component, members: the candidates among distinct units (id, sig)."""
    parts = max(8, -(-distinct.count() // item_rows))
    items = distinct.select("id", "sig", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("block"))
    lists = near.post(items, near.shared_tokens(items, kind.form, parts), kind.form, near.every_shared, parts, list_rows)
    return near.candidates(lists, kind.form, list_rows)


def unit_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, unit (its bytes) of the wanted units (digest, start, end, id): of each, from the text that has this digest."""
    rows = with_digest(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select("digest", F.encode("text", "UTF-8").alias("raw"))
    own = wanted.groupBy("digest").agg(F.collect_list(F.struct("id", "start", "end")).alias("w"))
    each = rows.join(own, "digest").select("raw", F.explode("w").alias("w"))
    return each.select("w.id", F.substring("raw", F.col("w.start").cast("int") + 1, (F.col("w.end") - F.col("w.start")).cast("int")).alias("unit")).dropDuplicates(["id"])


def verified(docs: DataFrame, distinct: DataFrame, close: DataFrame, kind: Kind, num: int, den: int) -> DataFrame:
    """id, component of the units that links with full sets join; the first occurrence of each candidate gives its text."""
    some = distinct.select("id", "first").join(close.select("id"), "id").select("id", "first.digest", "first.start", "first.end")
    return near.components(near.verify(settle(unit_texts(docs, some)), "unit", close, kind.sets, num, den))


def occurrences(found: DataFrame, distinct: DataFrame, joined: DataFrame) -> DataFrame:
    """doc_id, digest, place, start, end, component, keep (the place of the occurrence that stays) of the occurrences in
    components with two or more of them.

    Components are counted over distinct units, so that the occurrences themselves are shuffled once.
    """
    grouped = distinct.select("id", "n", "first").join(joined, "id", "left").where("n > 1 or component is not null")
    grouped = cut(grouped.withColumn("component", F.coalesce("component", "id")))
    keep = cut(grouped.groupBy("component").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n"), F.min("first").alias("keep")).where("total > 1").drop("total"))
    units = cut(near.beside(grouped.select("id", "component"), keep, "component", keep.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).drop("n"))
    return found.select("doc_id", "digest", "place", "start", "end", "id").join(units, "id").drop("id")


def per_document(docs: DataFrame, found: DataFrame, unit: str) -> DataFrame:
    """doc_id, digest (of identifier and text), n_linked, n_removed and removed (array of the unit's place, its bytes [start,
    end) and the occurrence that stays), a row for each different (doc_id, text) among ``docs``.

    An occurrence stays where it overlaps the one that its component keeps.
    """
    same = F.col("digest") == F.col("keep.digest")
    gone = ~(same & (F.col("start") < F.col("keep.end")) & (F.col("keep.start") < F.col("end")))
    what = F.struct(F.col("place").alias(unit), "start", "end", "component", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.place").alias(f"keep_{unit}"))
    own = found.groupBy("digest").agg(F.size(F.collect_set("place")).alias("n_linked"), F.sort_array(F.collect_set(F.when(gone, what))).alias("removed"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).alias("digest")).distinct()
    return ids.join(own, "digest", "left").select("doc_id", "digest", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), "removed")


def without(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs``, with any columns, without the bytes of the units removed from their text."""
    gone = removed.where("n_removed > 0").select(F.col("digest").alias("_digest"), F.expr("array_sort(transform(removed, x -> struct(x.start as s, x.end as e)))").alias("_cut"))
    rows = packed_others(docs, "doc_id", "text")
    own = rows.join(gone, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))) == F.col("_digest"), "left")
    # spans may overlap: what stays lies between the furthest end so far and the next start
    spans = F.concat("_cut", F.array(F.struct(F.octet_length("text").cast("long").alias("s"), F.octet_length("text").cast("long").alias("e"))))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    raw = F.encode("text", "UTF-8")

    def step(a, x):
        piece = F.decode(F.substring(raw, a["at"].cast("int") + 1, (x["s"] - a["at"]).cast("int")), "UTF-8")
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(x["s"] > a["at"], F.concat(a["out"], F.array(piece))).otherwise(a["out"]).alias("out"))

    left = F.array_join(F.aggregate(spans, zero, step)["out"], "")
    return unpacked(own.withColumn("text", F.when(F.col("_cut").isNull(), F.col("text")).otherwise(left)).drop("_digest", "_cut"), docs.columns)
