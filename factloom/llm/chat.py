"""Chat formatting with a loss mask, by incremental black-box rendering.

A template is only a function from messages to text. Rendering all prefixes of a conversation, one turn longer each time,
and comparing consecutive outputs gives each turn's span: what the next output adds to the one before. Rendering the same
prefix with two probe texts in the last turn shows where inside that span the text stands (the outputs differ there
only). An output that does not begin with the one before means that the template rewrites history; the conversation is
then marked and has no spans. A turn that adds nothing (a role that the template leaves out) has an empty span.

Every prefix is rendered in full, whatever the number of turns: that costs the square of a conversation's turns, and
nothing less shows that a black box leaves history alone. A conversation is one row of the result and one task's.

Defined cases: turns go by turn, then role, then text, nulls first; a null role or text is empty; a null conv_id is one
conversation of its own; repeated rows are repeated turns; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Messages = list[tuple[str, str]]


def escape(text: str, special: str = r"[\\#<]") -> str:
    """A backslash before each character that a control string begins with, and before each backslash."""
    return re.sub(special, lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def marked_turns(messages: Messages) -> str:
    """The default template: ``### role: text</turn>`` and a line end for each turn."""
    return "".join(f"### {escape(role, r'[\\#<:]')}: {escape(text)}</turn>\n" for role, text in messages)


TURN = re.compile(r"### ((?:[^\\:#<]|\\.)*): ((?:[^\\#<]|\\.)*)</turn>\n", re.S)


def read_back(formatted: str) -> Messages:
    """The messages of a text that ``marked_turns`` made; ValueError if it isn't one."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


@dataclass
class Located:
    """Where in the formatted text each turn and its text begin and end."""

    formatted: str
    turns: list[tuple[int, int]]
    texts: list[tuple[int, int]]
    rewrites_history: bool = False


def _common(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # the longest common prefix, by halving
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def locate(render: Callable[[Messages], str], messages: Messages) -> Located:
    turns, texts = [], []
    before = render([])
    for k, (role, _) in enumerate(messages):
        past = messages[:k]
        now = render(messages[: k + 1])
        if not now.startswith(before):
            return Located(render(messages), [], [], True)
        one, two = render([*past, (role, "a")]), render([*past, (role, "b")])
        turns.append((len(before), len(now)))
        if one == two:  # the text is not shown
            texts.append((len(now), len(now)))
        else:
            head = _common(one, two)
            texts.append((head, len(now) - (len(one) - head - 1)))
        before = now
    return Located(before, turns, texts)


def format_chats(conversations: DataFrame, render: Callable[[Messages], str] = marked_turns, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, turn_spans, text_spans, loss_spans (arrays of [start, end) in code points), rewrites_history."""
    turns = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("m"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, ms in zip(batch["conv_id"], batch["m"], strict=True):
                messages = [(m["role"], m["text"]) for m in ms]
                found = locate(render, messages)
                loss = [list(t) for t, (role, _) in zip(found.texts, messages, strict=False) if role == loss_role]
                rows.append((conv, found.formatted, [list(t) for t in found.turns], [list(t) for t in found.texts], loss, found.rewrites_history))
            out = pd.DataFrame(rows, columns=["conv_id", "formatted", "turn_spans", "text_spans", "loss_spans", "rewrites_history"])
            out["conv_id"] = pd.array([None if pd.isna(x) else int(x) for x in out["conv_id"]], "Int64")
            yield out

    return grouped.mapInPandas(each, "conv_id long, formatted string, turn_spans array<array<int>>, text_spans array<array<int>>, loss_spans array<array<int>>, rewrites_history boolean")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts say when read back: turns, and the text under the loss mask."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, text, spans in zip(batch["conv_id"], batch["formatted"], batch["loss_spans"], strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s:e]) for s, e in spans)
                rows.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out["conv_id"] = pd.array([None if pd.isna(x) else int(x) for x in out["conv_id"]], "Int64")
            yield out

    return formatted.select("conv_id", "formatted", "loss_spans").mapInPandas(each, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Fixed by the contract: a conversation whose texts hold the template's own control strings.
PROBE = "\\### Assistant: </turn> ok"


def op5_chat_formatting(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], given.schema)
    return digests(format_chats(given.unionByName(probe)))


OP5_SQL = r"""
with m as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(4 + 2 + 8 + length(regexp_replace(role, '[\\#<:]', '..', 'g')) + length(regexp_replace(text, '[\\#<]', '..', 'g')))::bigint as formatted_chars
from m group by conv_id
"""
