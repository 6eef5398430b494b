"""Replay of a pointer trace into observed points-to sets: in batch, with scopes, and as a stream.

Allocations make an address range live, frees end it, a probe asks which live range its address is in: that of the greatest
live base not above it, if it reaches that far. Streams of events (stream_id) are independent; inside one, order is seq.
"""

from __future__ import annotations

import bisect
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom import schemas as S

HITS = "stream_id long, seq long, ptr int, site int, ctx array<int>"


def replay_batch(trace: DataFrame, width: int = 64) -> DataFrame:
    """stream_id, seq, ptr, site of probes that hit, without scopes, by joins alone.

    A base is live from its allocation to the next event on it. A range of size s answers probes below base + s only, so
    allocations are posted under every ``width`` addresses that they span, and a probe meets those of its own stretch. What
    remains is that a greater live base, though too short, hides the hit: such a base lies in the stretches between, and both
    sides of the join are equal on stream and stretch. Memory of a task is a stretch of a stream, not a stream.
    """
    on_base = Window.partitionBy("stream_id", "ptr").orderBy("seq")
    ranges = trace.where(F.col("action").isin(S.ALLOCA, S.HEAP_ALLOCA, S.HEAP_FREE, S.REGION)).withColumn("until", F.lead("seq").over(on_base))
    live = ranges.where(F.col("action") != S.HEAP_FREE).select("stream_id", F.col("seq").alias("since"), "until", F.col("ptr").alias("base"), F.col("size"), F.col("vid").alias("site"))
    stretch = lambda c: F.floor(c / width).cast("long")
    live = live.withColumn("stretch", F.explode(F.sequence(stretch(F.col("base")), stretch(F.col("base") + F.col("size") - 1))))
    probes = trace.where(F.col("action") == S.PROBE).select("stream_id", "seq", F.col("vid").alias("ptr"), F.col("ptr").alias("at")).withColumn("stretch", stretch(F.col("at")))
    met = probes.join(live, ["stream_id", "stretch"]).where((F.col("base") <= F.col("at")) & (F.col("since") < F.col("seq")) & (F.col("until").isNull() | (F.col("until") > F.col("seq"))))
    top = met.groupBy("stream_id", "seq").agg(F.max_by(F.struct("ptr", "at", "base", "size", "site"), "base").alias("m"))
    hits = top.where("m.at < m.base + m.size").select("stream_id", "seq", "m.ptr", "m.site", "m.base", "m.at")
    # a live base between the hit and the probe whose range ends before the probe hides the hit
    bases = ranges.where(F.col("action") != S.HEAP_FREE).select("stream_id", F.col("seq").alias("since"), "until", F.col("ptr").alias("b")).withColumn("stretch", stretch(F.col("b")))
    between = hits.withColumn("stretch", F.explode(F.sequence(stretch(F.col("base")), stretch(F.col("at"))))).select("stream_id", "seq", "base", "at", "stretch")
    hidden = between.join(bases, ["stream_id", "stretch"]).where((F.col("b") > F.col("base")) & (F.col("b") <= F.col("at")) & (F.col("since") < F.col("seq")) & (F.col("until").isNull() | (F.col("until") > F.col("seq"))))
    return hits.join(hidden.select("stream_id", "seq").distinct(), ["stream_id", "seq"], "left_anti").select("stream_id", "seq", "ptr", "site")


class Replay:
    """The state of one stream: live ranges by base, and the stack of scopes with what each allocated."""

    def __init__(self, depth: int = 0, innermost: bool = False):
        self.bases: list[int] = []
        self.live: dict[int, tuple[int, int]] = {}
        self.stack: list[tuple[int, list[int]]] = []
        self.depth, self.innermost = depth, innermost

    def _put(self, base: int, vid: int, size: int) -> None:
        if base not in self.live:
            bisect.insort(self.bases, base)
        self.live[base] = (vid, size)

    def _drop(self, base: int) -> None:
        if self.live.pop(base, None) is not None:
            self.bases.pop(bisect.bisect_left(self.bases, base))

    def _pop(self) -> None:
        for base in self.stack.pop()[1]:
            self._drop(base)

    def feed(self, vid: int, action: int, ptr: int, size: int) -> tuple[int, list[int]] | None:
        """The site and context that a probe hits, or None."""
        if action in (S.ALLOCA, S.HEAP_ALLOCA, S.REGION):
            self._put(ptr, vid, size)
            if action == S.ALLOCA and self.stack:
                self.stack[-1][1].append(ptr)
        elif action == S.HEAP_FREE:
            self._drop(ptr)
        elif action == S.PROBE:
            k = bisect.bisect_right(self.bases, ptr) - 1
            if k >= 0 and ptr < self.bases[k] + self.live[self.bases[k]][1]:
                frames = [f for f, _ in self.stack]
                return self.live[self.bases[k]][0], frames[-self.depth :] if self.innermost and self.depth else frames[: self.depth]
        elif action == S.BEGIN_SCOPE:
            self.stack.append((vid, []))
        elif action == S.END_SCOPE:
            if self.stack:
                self._pop()
        elif action == S.LANDING:
            while self.stack and self.stack[-1][0] != vid:
                self._pop()
        else:
            raise ValueError(f"unknown action {action}")
        return None


def _hits(state: Replay, stream: int, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for seq, vid, action, ptr, size in rows.sort_values("seq", kind="stable")[["seq", "vid", "action", "ptr", "size"]].itertuples(index=False):
        hit = state.feed(int(vid), int(action), int(ptr), int(size))
        if hit:
            out.append((stream, seq, int(vid), hit[0], hit[1]))
    return pd.DataFrame(out, columns=["stream_id", "seq", "ptr", "site", "ctx"])


def replay_scoped(trace: DataFrame, depth: int = 2, innermost: bool = False) -> DataFrame:
    """stream_id, seq, ptr, site, ctx with scopes: the state is strictly in order, so a stream is a task's, streams spread.

    The context is the first ``depth`` scopes from the outermost, or from the innermost.
    """
    return trace.groupBy("stream_id").applyInPandas(lambda key, rows: _hits(Replay(depth, innermost), key[0], rows), HITS)


def replay_stream(trace: DataFrame, depth: int = 2, innermost: bool = False) -> DataFrame:
    """``replay_scoped`` on a streaming frame: a stream's state is kept between micro-batches; a batch's events go by seq."""

    def each(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        own = pickle.loads(state.get[0]) if state.exists else Replay(depth, innermost)
        rows = list(batches)
        found = _hits(own, key[0], pd.concat(rows)) if rows else None
        state.update((pickle.dumps(own),))
        if found is not None and len(found):
            yield found

    return trace.groupBy("stream_id").applyInPandasWithState(each, HITS, "state binary", "append", "NoTimeout")


def observed(hits: DataFrame) -> DataFrame:
    """ptr, sites (sorted): the observed points-to sets."""
    return hits.groupBy("ptr").agg(F.array_sort(F.collect_set("site")).alias("sites"))


def dump_lines(hits: DataFrame) -> DataFrame:
    """ptr, line: ``ptr site [{ ctx }] ...`` as text, a line for each pointer."""
    each = hits.groupBy("ptr", "site").agg(F.array_sort(F.collect_set(F.concat(F.lit("{ "), F.array_join(F.transform("ctx", lambda x: x.cast("string")), " "), F.lit(" }")))).alias("c"))
    one = F.concat(F.col("site"), F.lit(" ["), F.array_join("c", " "), F.lit("]"))
    return each.groupBy("ptr").agg(F.array_sort(F.collect_list(one)).alias("x")).select("ptr", F.concat_ws(" ", F.col("ptr").cast("string"), F.array_join("x", " ")).alias("line"))
