"""What the near-duplicate operators share: MinHash signatures, posting lists, exact verification and union-find.

An *item* is a distinct set (of shingles) with an identifier. The steps, each a Spark shuffle by a small key whose values
are packed arrays, so that numpy works inside tasks and Spark deals out the work:

1. ``shared_tokens``: every block of items posts its distinct tokens (coordinate-value pairs, or bands of them) once,
   with how many of its items have them; a bucket adds up what the blocks say and answers with the tokens that two items
   or more have, and their frequencies. A token of a third of all items is one entry for each block.
2. ``post``: with these answers a block posts its items under the tokens that it selects, with a short form of the
   signature. A list of more than ``list_rows`` items is dealt out to parts, in another way for each token.
3. ``candidates``: within a list or a part, pairs that are close are candidate links. Pairs inside one group say nothing
   new, so a list returns a spanning forest of stars, never its pairs. Then the parts of a large list meet (see 6).
4. ``components``: distributed union-find (large star, small star) over these.
5. ``verify``: a candidate cluster's full sets meet; pairs are compared exactly, but for those that verified links
   already join, and a spanning forest of exact links is returned. A cluster of more than ``cluster_rows`` items is dealt
   out to parts, each of which also has the cluster's first item; smaller ones share packs.
6. ``across``: what is compared between the parts of a large group. Of the components that the parts' links give, the
   largest needs no comparison inside itself: only the items left over meet all others, in pairs of parts. A group of n
   near copies is n comparisons, not their square.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import binaries, cut, drop, mix, order_within, settle

#: Odd multipliers of the signature's coordinates, made by rule.
_MULTIPLIERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


@dataclass(frozen=True)
class Form:
    """How signatures are kept and compared: the bytes of one (``width``), the 64-bit tokens of a matrix of them, the part of
    one that posting lists carry (``posted`` bytes of it), and whether rows of two such matrices are candidates."""

    width: int
    tokens: Callable[[np.ndarray], np.ndarray]
    posted: int
    shorten: Callable[[np.ndarray], np.ndarray]
    close: Callable[[np.ndarray, np.ndarray], np.ndarray]


def signatures(h: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """MinHash of k coordinates, as uint32, of the sets ``h[starts[i]:starts[i + 1]]`` (64-bit hashes, none empty)."""
    out = np.empty((len(starts) - 1, k), np.uint32)
    if len(out):
        for j in range(k):
            out[:, j] = np.minimum.reduceat(h * _MULTIPLIERS[j] + _MULTIPLIERS[j + 64 & 255], starts[:-1]) >> np.uint64(32)
    return out


def coordinate_tokens(sig: np.ndarray) -> np.ndarray:
    """A 64-bit token for each coordinate and its value."""
    return mix((np.arange(sig.shape[1], dtype=np.uint64) << np.uint64(32)) | sig.astype(np.uint64))


def band_tokens(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit token for each band of ``rows`` coordinates."""
    bands = sig.shape[1] // rows
    out = np.tile(np.arange(bands, dtype=np.uint64), (len(sig), 1))
    for r in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + sig[:, r : bands * rows : rows].astype(np.uint64) + np.uint64(r))
    return out


def coordinates(k: int, least: int, tokens: Callable[[np.ndarray], np.ndarray]) -> Form:
    """Signatures of k coordinates of 32 bits; lists carry a byte of each, and ``least`` equal ones make a candidate."""
    return Form(4 * k, lambda m: tokens(m.view(np.uint32)), k, lambda m: np.ascontiguousarray(m[:, ::4]), lambda x, y: (x == y).sum(axis=-1) >= least)


# ---- union-find on arrays ------------------------------------------------------------------------------------------


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index in each index's component of the links (a, b), by hooking to smaller labels and jumping."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label


def groups_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts keys (stable), and starts and ends of the runs of equal keys in it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return order, start, np.r_[start[1:], len(k)] if len(k) else start


# ---- links inside groups, in a task --------------------------------------------------------------------------------


def forest(start: np.ndarray, end: np.ndarray, ids: np.ndarray, compare: Callable[[np.ndarray, np.ndarray], np.ndarray], side: np.ndarray | None = None, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b), as spanning forests, of all pairs inside the groups [start, end) of rows that ``compare`` accepts.

    The groups go in step: in step k the k-th row of each meets the rows behind it that nothing joins it with yet
    (``label``: what is joined from the start). Rows on one side (1 or 2; 0 is both) don't meet.
    """
    n = len(ids)
    group = np.repeat(np.arange(len(start)), end - start)
    rank = np.arange(n) - start[group]
    label = np.arange(n) if label is None else label
    a, b = [ids[:0]], [ids[:0]]
    rows = np.flatnonzero(rank > 0)
    for k in range(int((end - start).max(initial=0)) - 1):
        rows = rows[rank[rows] > k]
        p = start[group[rows]] + k
        pick = label[rows] != label[p]
        if side is not None:
            pick &= (side[p] == 0) | (side[p] != side[rows])
        p, rest = p[pick], rows[pick]
        if len(rest):
            good = compare(p, rest)
            p, rest = p[good], rest[good]
        if len(rest):
            old, first = np.unique(label[rest], return_index=True)
            a.append(ids[p[first]])
            b.append(ids[rest[first]])
            to = np.arange(n)
            to[old] = label[p[first]]
            label = to[label]
    return np.concatenate(a), np.concatenate(b)


def _elements(h: np.ndarray, bounds: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Numbers of the elements: equal ones are equal hashes of one group."""
    owner = np.repeat(group, np.diff(bounds))
    first = np.flatnonzero(np.diff(group, prepend=-1))
    order = order_within(h, np.r_[bounds[first], len(h)])
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    element = np.empty(len(h), np.int64)
    element[order] = np.cumsum(new) - 1
    return element


def set_comparer(h: np.ndarray, bounds: np.ndarray, group: np.ndarray, num: int, den: int, chunk: int = 1 << 22) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """For ``forest``: whether the sets ``h[bounds[i]:bounds[i + 1]]`` of two rows have den * |x & y| >= num * |x | y|.
    ``group``: each row's group; rows come group by group."""
    size = np.diff(bounds)
    element = _elements(h, bounds, group)
    marked = np.zeros(len(h) + 1, bool)

    def elements(rows: np.ndarray) -> np.ndarray:
        n = size[rows]
        return element[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[:-1][rows], n)]

    def compare(p: np.ndarray, rows: np.ndarray) -> np.ndarray:
        x, y = size[p], size[rows]
        out = (den * np.minimum(x, y) >= num * np.maximum(x, y)) & (x > 0) & (y > 0)
        some = np.flatnonzero(out)
        if not len(some):
            return out
        own = elements(np.unique(p[some]))
        marked[own] = True
        total = np.cumsum(y[some])
        lo = 0
        while lo < len(some):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + chunk)))
            part = some[lo:hi]
            common = np.add.reduceat(marked[elements(rows[part])].astype(np.int64), np.cumsum(y[part]) - y[part])
            out[part] = den * common >= num * (x[part] + y[part] - common)
            lo = hi
        marked[own] = False
        return out

    return compare


def _alike(element: np.ndarray, bounds: np.ndarray, x: np.ndarray, y: np.ndarray, num: int, den: int, chunk: int = 1 << 20) -> np.ndarray:
    """Whether the sets of x[i] and y[i] have den * |x & y| >= num * |x | y|."""
    size = np.diff(bounds)
    width = int(element.max(initial=0)) + 1
    out = np.zeros(len(x), bool)
    total = np.r_[0, np.cumsum(size[x] + size[y])]
    lo = 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + chunk, "right")) - 1)
        rows = np.stack([x[lo:hi], y[lo:hi]], axis=1).ravel()
        n = size[rows]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[:-1][rows], n)
        key = np.sort(np.repeat(np.arange(hi - lo), np.diff(total[lo : hi + 1])) * width + element[at])
        common = np.bincount(key[1:][key[1:] == key[:-1]] // width, minlength=hi - lo)
        out[lo:hi] = den * common >= num * (np.diff(total[lo : hi + 1]) - common)
        lo = hi
    return out


def set_links(h: np.ndarray, bounds: np.ndarray, group: np.ndarray, ids: np.ndarray, num: int, den: int, side: np.ndarray, label: np.ndarray, chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """What ``forest`` with ``set_comparer`` joins, as a spanning forest over the labels, where most rows of large groups are unlike.

    The elements of sets that are alike, ordered alike from the rarest on, have a first one in common, with all others of the
    common ones behind it in both: (num + den) * (elements from it on) >= num * (|x| + |y|). So rows meet under their rarest
    elements, and all such pairs are compared in full, the first row of every list first, while they are not joined yet.
    """
    n, size = len(ids), np.diff(bounds)
    element = _elements(h, bounds, group)
    freq = np.bincount(element)
    order = np.argsort(freq, kind="stable")
    rank = np.empty(len(freq), np.int64)
    rank[order] = np.arange(len(freq))
    row = np.repeat(np.arange(n), size)
    element = np.sort(row * len(freq) + rank[element]) - row * len(freq)
    left = bounds[1:][row] - np.arange(len(row))
    use = np.flatnonzero((den * left >= num * size[row]) & (freq[order][element] > 1))
    use = use[np.sort(element[use] * len(use) + np.arange(len(use))) % max(1, len(use))]
    who, left = row[use], left[use]
    _, start, end = groups_of(element[use])
    in_list = np.repeat(np.arange(len(start)), end - start)
    behind = end[in_list] - np.arange(len(use)) - 1
    todo = np.argsort(np.arange(len(use)) - start[in_list], kind="stable")
    root, step = np.arange(n), 1 << 14
    while len(todo):
        own = root[label]
        mixed = np.minimum.reduceat(own[who], start) != np.maximum.reduceat(own[who], start)
        todo = todo[mixed[in_list[todo]] & (behind[todo] > 0)]
        k = max(1, int(np.searchsorted(np.cumsum(behind[todo]), step, "right")))
        some, todo = todo[:k], todo[k:]
        m = behind[some]
        a = np.repeat(some, m)
        b = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(some + 1, m)
        x, y = who[a], who[b]
        pick = (own[x] != own[y]) & (side[x] != side[y]) & ((num + den) * np.minimum(left[a], left[b]) >= num * (size[x] + size[y]))
        pair = np.unique(x[pick] * np.int64(n) + y[pick])
        x, y = pair // n, pair % n
        good = _alike(element, bounds, x, y, num, den)
        root = roots(n, np.r_[np.arange(n), own[x[good]]], np.r_[root, own[y[good]]])
        step = min(2 * step, chunk)
    own, first = np.unique(label, return_index=True)
    joined = root[own] != own
    return ids[first[np.searchsorted(own, root[own[joined]])]], ids[first[joined]]


# ---- posting lists -------------------------------------------------------------------------------------------------


def _joined(table: pa.Table, name: str, dtype) -> np.ndarray:
    """The packed arrays of a binary column one after the other."""
    return np.frombuffer(b"".join(x.as_py() for x in table.column(name)), dtype)


def _counts(table: pa.Table, name: str, width: int) -> np.ndarray:
    return np.array([len(x.as_py()) // width for x in table.column(name)], np.int64)


def _dealt(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    order, start, end = groups_of(bucket)
    return order, [(int(bucket[order[s]]), int(s), int(e)) for s, e in zip(start, end, strict=True)]


SHARED = pa.schema([("block", pa.int64()), ("tokens", pa.binary()), ("freqs", pa.binary())])
_POSTED = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("tokens", pa.binary()), ("counts", pa.binary())])
_LISTS = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("parts", pa.binary()), ("ids", pa.binary()), ("sigs", pa.binary())])
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sig", pa.binary())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    return _joined(table, "sig", np.uint8).reshape(-1, width)


def _short(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """A token's bucket and, below it, 32 of its bits: tokens cut short can only make more candidates."""
    return ((tokens % np.uint64(buckets)) << np.uint64(32)) | (tokens >> np.uint64(32))


def shared_tokens(items: DataFrame, form: Form, buckets: int) -> DataFrame:
    """block, tokens, freqs: for each block of items (block, id, sig), its tokens that two items or more have anywhere."""

    def post(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        key, n = np.unique(_short(form.tokens(_matrix(table, form.width)), buckets).ravel(), return_counts=True)
        value, n = key.astype(np.uint32), np.minimum(n, 65535).astype(np.uint16)
        _, parts = _dealt((key >> np.uint64(32)).astype(np.int64))
        return pa.table([[b for b, _, _ in parts], [block] * len(parts), [value[s:e].tobytes() for _, s, e in parts], [n[s:e].tobytes() for _, s, e in parts]], schema=_POSTED)

    def add_up(table: pa.Table) -> pa.Table:
        bucket = np.uint64(table.column("bucket")[0].as_py())
        t, n = _joined(table, "tokens", np.uint32), _joined(table, "counts", np.uint16).astype(np.int64)
        sizes = _counts(table, "tokens", 4)
        _, which = np.unique(t, return_inverse=True)
        total = np.bincount(which, n).astype(np.int64)[which]
        out, at = [], 0
        for block, size in zip(table.column("block").to_pylist(), sizes, strict=True):
            own = slice(at, at + size)
            keep = total[own] > 1
            at += size
            if keep.any():
                keys = (bucket << np.uint64(32)) | t[own][keep].astype(np.uint64)
                out.append((block, keys.tobytes(), np.minimum(total[own][keep], 0xFFFFFFFF).astype(np.uint32).tobytes()))
        return pa.table([list(x) for x in zip(*out, strict=True)] if out else [[], [], []], schema=SHARED)

    posted = items.select("block", "id", "sig").groupBy("block").applyInArrow(post, "bucket long, block long, tokens binary, counts binary")
    return posted.groupBy("bucket").applyInArrow(add_up, "block long, tokens binary, freqs binary")


def prefix_of(least: int):
    """Selects by the prefix filter: items that share ``least`` tokens share one of the rarest n - least + 1 of the n tokens
    that either shares with anyone; items with fewer than ``least`` such tokens are skipped."""

    def choose(tokens: np.ndarray, freq: np.ndarray) -> np.ndarray:
        n = (freq > 1).sum(axis=1)
        order = np.lexsort((tokens, np.where(freq > 1, freq, 1 << 40)), axis=1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(tokens.shape[1])[None, :], axis=1)
        return (freq > 1) & (rank < (n - least + 1)[:, None])

    return choose


def every_shared(tokens: np.ndarray, freq: np.ndarray) -> np.ndarray:
    return freq > 1


def _part(ids: np.ndarray, keys: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The list that an item of a large one goes to: near copies then share parts of some of their many lists."""
    part = mix(ids.astype(np.uint64) ^ mix(keys)) % parts.astype(np.uint64)
    return mix(keys ^ mix(part + np.uint64(1)))


def post(items: DataFrame, shared: DataFrame, form: Form, choose, buckets: int, list_rows: int) -> DataFrame:
    """Posting lists, packed by bucket: keys, parts (how many a large list has; empty if all lists are small), ids, sigs."""

    def each(_, own: pa.Table, known: pa.Table) -> pa.Table:
        if not own.num_rows or not known.num_rows:
            return _LISTS.empty_table()
        sig, ids = _matrix(own, form.width), own.column("id").to_numpy()
        t, f = _joined(known, "tokens", np.uint64), _joined(known, "freqs", np.uint32)
        order = np.argsort(t)
        t, f = t[order], f[order]
        tokens = _short(form.tokens(sig), buckets)
        at = np.minimum(np.searchsorted(t, tokens), len(t) - 1)
        freq = np.where(t[at] == tokens, f[at], 1).astype(np.int64)
        row, col = np.nonzero(choose(tokens, freq))
        key, parts = tokens[row, col], -(-freq[row, col] // list_rows)
        short = form.shorten(sig)
        out = [[], [], [], [], []]
        for large in (False, True):
            some = np.flatnonzero((parts > 1) == large)
            k, r, p = key[some], row[some], parts[some].astype(np.uint32)
            order, dealt = _dealt((mix(_part(ids[r], k, p) if large else k) % np.uint64(buckets)).astype(np.int64))
            k, r, p = k[order], r[order], p[order]
            for b, s, e in dealt:
                for column, x in zip(out, (b, k[s:e].tobytes(), p[s:e].tobytes() if large else b"", ids[r[s:e]].tobytes(), short[r[s:e]].tobytes()), strict=True):
                    column.append(x)
        return pa.table(out, schema=_LISTS)

    left, right = items.select("block", "id", "sig").groupBy("block"), shared.groupBy("block")
    return left.cogroup(right).applyInArrow(each, "bucket long, keys binary, parts binary, ids binary, sigs binary")


def collide(lists: DataFrame, form: Form, small: int = 32, chunk: int = 1 << 19) -> DataFrame:
    """a, b, sig: where sig is null, a spanning forest of the close pairs within each posting list or part; else an item b of
    the large list a, with its short signature."""

    def each(table: pa.Table) -> pa.Table:
        sizes = _counts(table, "keys", 8)
        key, all_ids, sigs = _joined(table, "keys", np.uint64), _joined(table, "ids", np.int64), _joined(table, "sigs", np.uint8).reshape(-1, form.posted)
        large = np.repeat([len(x.as_py()) > 0 for x in table.column("parts")], sizes).astype(bool)
        lists_key = key.copy()
        lists_key[large] = _part(all_ids[large], key[large], _joined(table, "parts", np.uint32))
        uniq, item = np.unique(all_ids, return_inverse=True)
        sig = np.empty((len(uniq), form.posted), np.uint8)
        sig[item] = sigs
        order, start, end = groups_of(lists_key)
        member, size = item[order], end - start
        links: list[tuple[np.ndarray, np.ndarray]] = []
        label = np.arange(len(uniq))
        is_small = (size > 1) & (size <= small)
        s, n = start[is_small], size[is_small]
        lo = 0
        while lo < len(s):  # all pairs of the small lists, some lists at a time; they stay inside this loop
            hi = max(lo + 1, int(np.searchsorted(np.cumsum(n[lo:] ** 2), chunk)) + lo)
            m, first = n[lo:hi], s[lo:hi]
            i = np.arange((m**2).sum()) - np.repeat(np.cumsum(m**2) - m**2, m**2)
            mm = np.repeat(m, m**2)
            x, y = np.repeat(first, m**2) + i // mm, np.repeat(first, m**2) + i % mm
            pick = x < y
            x, y = member[x[pick]], member[y[pick]]
            open_ = label[x] != label[y]
            pairs = np.unique(np.minimum(x, y)[open_] * np.int64(len(uniq)) + np.maximum(x, y)[open_])
            x, y = pairs // len(uniq), pairs % len(uniq)
            good = np.concatenate([form.close(sig[x[c : c + chunk]], sig[y[c : c + chunk]]) for c in range(0, len(x), chunk)] or [np.zeros(0, bool)])
            links.append((x[good], y[good]))
            label = roots(len(uniq), np.concatenate([a for a, _ in links]), np.concatenate([b for _, b in links]))
            lo = hi
        for s0, e0 in zip(start[size > small], end[size > small], strict=True):
            members = member[s0:e0]
            for i in range(len(members) - 1):
                m = members[i]
                rest = members[i + 1 :]
                rest = rest[label[rest] != label[m]]
                if not len(rest):
                    continue
                rest = rest[form.close(sig[rest], sig[m])]
                if len(rest):
                    touched = np.unique(np.r_[label[rest], label[m]])
                    label[np.isin(label, touched)] = touched[0]
        outside = np.flatnonzero(label != np.arange(len(uniq)))
        held = np.flatnonzero(large)
        data = binaries(sigs[held].ravel(), np.arange(len(held) + 1) * form.posted)
        return pa.table(
            [np.r_[uniq[outside], key[held].view(np.int64)], np.r_[uniq[label[outside]], all_ids[held]], pa.concat_arrays([pa.nulls(len(outside), pa.binary()), data])],
            schema=_FOUND,
        )

    return lists.groupBy("bucket").applyInArrow(each, "a long, b long, sig binary")


def candidates(lists: DataFrame, form: Form, list_rows: int) -> DataFrame:
    """id, component, members: the clusters that candidate links of all lists make."""
    found = settle(collide(lists, form))
    label = components(found.where("sig is null").select("a", "b"))
    large = found.where("sig is not null").select(F.col("a").alias("group"), F.col("b").alias("id"), "sig")
    if not large.isEmpty():

        def compared(sigs: pa.ChunkedArray, start, end, _group, ids, side, label):
            sig = np.frombuffer(b"".join(x.as_py() for x in sigs), np.uint8).reshape(-1, form.posted)
            return forest(start, end, ids, lambda p, rows: form.close(sig[p], sig[rows]), side, label)

        rest = across(large.select("id", "sig").dropDuplicates(["id"]), "sig", large.select("group", "id"), label, compared, list_rows)
        label = components(label.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(rest))
    return cut(with_members(label))


# ---- union-find on Spark -------------------------------------------------------------------------------------------


def beside(rows: DataFrame, totals: DataFrame, key: str, n_rows: int) -> DataFrame:
    """Inner join with ``totals`` (cut; one row a key, ``n``: how many of the ``n_rows`` rows have it).

    Keys with more than a thousandth of all rows (at every size, of which there are at most a thousand) are broadcast, so that none
    of them is one task's.
    """
    hot = totals.where(F.col("n") > n_rows // 1000)
    if hot.isEmpty():
        return rows.join(totals, key)
    own = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(totals.where(F.col("n") <= n_rows // 1000), key)
    return own.unionByName(others)


def components(links: DataFrame, most_rounds: int = 40, edges_a_task: int = 200_000) -> DataFrame:
    """id, component (the smallest id it is linked with, over any number of links) of every id in the links (a, b).

    Each task first joins what it has itself into stars; then large-star and small-star rounds alternate on Spark until a
    round finds nothing but stars. A node with a third of all links is only an aggregated minimum and a broadcast row.
    """

    def local(batches):
        parts = [b for b in batches if b.num_rows]
        if parts:
            t = pa.Table.from_batches(parts)
            a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
            uniq, where = np.unique(np.r_[a, b], return_inverse=True)
            label = roots(len(uniq), where[: len(a)], where[len(a) :])
            out = np.flatnonzero(label != np.arange(len(uniq)))
            yield pa.RecordBatch.from_arrays([pa.array(uniq[out]), pa.array(uniq[label[out]])], schema=LINKS)

    def few(df: DataFrame, rows: int) -> DataFrame:
        """So many tasks as the edges need: a round on few edges is not hundreds of tasks for each of its stages."""
        return df.coalesce(max(8, -(-rows // edges_a_task)))

    # from here each edge is (a, b) with b < a
    edges = settle(links.where("a is not null and b is not null and a <> b").mapInArrow(local, "a long, b long"))
    n, first = edges.count(), edges
    edges = settle(few(edges, n).mapInArrow(local, "a long, b long"))
    drop(first)
    for _ in range(most_rounds):
        n = edges.count()
        if not n:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(few(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")), 2 * n))
        if least.where("m < a and n > 1").isEmpty():  # only centres have more than one edge: these are stars
            drop(least)
            break
        large = settle(few(beside(both.where("b > a"), least, "a", 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), n))
        drop(edges, least)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = settle(few(small.where("a <> b").distinct(), n))
        drop(large)
    else:
        raise RuntimeError("union-find has not converged")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def with_members(found: DataFrame) -> DataFrame:
    """id, component, members (how many ids the component has)."""
    sizes = cut(found.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    return beside(found, sizes, "component", sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).withColumnRenamed("n", "members")


# ---- exact verification --------------------------------------------------------------------------------------------


def _in_groups(of: str, linked: Callable) -> Callable[[pa.Table], pa.Table]:
    """The task of ``verify`` and ``across``: links within each group of the table (id, group, side and label where there
    are such, and the column that ``linked`` compares rows by)."""

    def each(table: pa.Table) -> pa.Table:
        if table.num_rows < 2:
            return LINKS.empty_table()
        table = table.sort_by([("group", "ascending"), ("id", "ascending")])
        key, ids = table.column("group").to_numpy(), table.column("id").to_numpy()
        _, start, end = groups_of(key)
        group = np.repeat(np.arange(len(start)), end - start)
        side = label = None
        if "side" in table.column_names:
            side = table.column("side").to_numpy()
            own = np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
            label = np.unique(group * np.int64(len(ids)) + own, return_inverse=True)[1]
        a, b = linked(table.column(of), start, end, group, ids, side, label)
        return pa.table([a, b], schema=LINKS)

    return each


def across(payload: DataFrame, of: str, members: DataFrame, labels: DataFrame, compared: Callable, rows: int) -> DataFrame:
    """a, b: links inside the groups of ``members`` (group, id) between items that ``labels`` (id, component) don't join yet.

    ``payload``: id and the column ``of``. Of each group the items of its most frequent label don't meet each other; all others
    meet all, in pairs of parts of about ``rows`` items.
    """
    own = cut(members.join(labels, "id", "left").select("group", "id", F.coalesce("component", "id").alias("label")))
    counted = own.groupBy("group", "label").agg(F.count(F.lit(1)).alias("c"))
    top = counted.groupBy("group").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("n"))
    top = cut(top.where(F.col("n") > F.col("top.c")).select("group", "n", F.col("top.label").alias("most"), F.ceil((F.col("n") - F.col("top.c")) / rows).cast("int").alias("pf"), F.ceil(F.col("n") / rows).cast("int").alias("pn")))
    met = beside(own, top, "group", top.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    part = lambda of_: F.pmod(F.xxhash64("id", F.lit(3)), of_).cast("int")
    all_ = met.select("group", "id", "label", F.explode(F.sequence(F.lit(0), F.col("pf") - 1)).alias("lo"), part(F.col("pn")).alias("hi"), F.lit(2).alias("side"))
    few = met.where(F.col("label") != F.col("most")).select("group", "id", "label", part(F.col("pf")).alias("lo"), F.explode(F.sequence(F.lit(0), F.col("pn") - 1)).alias("hi"), F.lit(1).alias("side"))
    dealt = all_.unionByName(few)
    return payload.join(dealt, "id").groupBy("group", "lo", "hi").applyInArrow(_in_groups(of, compared), "a long, b long")


def verify(payload: DataFrame, of: str, clusters: DataFrame, sets_of: Callable, num: int = 4, den: int = 5, cluster_rows: int = 512, pack_rows: int = 1024) -> DataFrame:
    """a, b: exact links (similarity at least num / den) inside candidate clusters, as spanning forests.

    ``payload``: id and the column ``of`` (a text), of which ``sets_of`` makes sorted distinct uint64 and their bounds, equal
    numbers for equal elements of one call; ``clusters``: id, component (one of its ids), members.
    """

    def compared(column: pa.ChunkedArray, start, end, group, ids, side, label):
        h, bounds = sets_of(column)
        if side is not None:
            return set_links(h, bounds, group, ids, num, den, side, label)
        return forest(start, end, ids, set_comparer(h, bounds, group, num, den))

    packs = max(8, -(-clusters.count() // pack_rows))
    parts = F.ceil(F.col("members") / F.lit(cluster_rows)).cast("int")
    large = F.col("members") > cluster_rows
    own = F.array(F.pmod(F.xxhash64("id", "component"), parts).cast("int"))
    lo = F.explode(F.when(large & (F.col("id") == F.col("component")), F.sequence(F.lit(0), parts - 1)).otherwise(own))
    dealt = clusters.select("id", F.col("component").alias("group"), large.alias("large"), F.when(large, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(packs))).alias("pack"), lo.alias("lo"))
    links = payload.join(dealt, "id").groupBy("large", "pack", "lo").applyInArrow(_in_groups(of, compared), "a long, b long")
    big = clusters.where(large).select(F.col("component").alias("group"), "id")
    if big.isEmpty():
        return links
    links = settle(links)
    return links.unionByName(across(payload, of, big, components(links), compared, cluster_rows))
