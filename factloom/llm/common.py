"""What the operators share: the shared folder, and vectorised work on the bytes of an Arrow text column."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the contracts: what separates words.
SPACES = "[\\x20\\x09-\\x0D]+"
NOT_SPACES = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, one in the warehouse."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Folders that ``settle`` wrote and nobody has removed yet.
_settled: list[str] = []


#: Spark's own setting: the shuffle files of a query go when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: it outlives any executor. The shuffle files that
    led to it are of no more use and go at once; otherwise they would stay until the driver collects garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    _settled.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled() -> set[str]:
    """The folders that stand now."""
    return set(_settled)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _settled.remove(path)


def _read_by(df: DataFrame) -> set[str]:
    return {f.rsplit("/", 2)[-2] for f in df.inputFiles()}


def drop(*used_up: DataFrame) -> None:
    """Removes the folders of settled frames that nothing reads any more."""
    for df in used_up:
        own = _read_by(df)
        _remove(df.sparkSession, [p for p in _settled if p.rsplit("/", 1)[-1] in own])


def clear_settled(spark: SparkSession, spared: set[str], read: DataFrame | None = None) -> None:
    """Removes what was settled but for the folders ``spared`` and those that ``read`` reads: for callers whose earlier frames
    are used up."""
    own = _read_by(read) if read is not None else set()
    _remove(spark, [p for p in _settled if p not in spared and p.rsplit("/", 1)[-1] not in own])


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on Spark hands its texts to Python in batches of at most 1,000 rows and about 4 MB, so that buffers on
    either side of the pipe stay small whatever the number of rows of a partition."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return df


def cut(df: DataFrame) -> DataFrame:
    """``checkpoint()``: lineage ends in the shared folder, and Spark removes the files with the frame."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def named(column: str) -> F.Column:
    """A column by its name as it stands, dots and backticks included."""
    return F.col(f"`{column.replace('`', '``')}`")


def packed_others(docs: DataFrame, *plain: str) -> DataFrame:
    """The plain columns and, as one struct, all others, so that no name of theirs meets one that an operator adds. A struct needs a
    field even if there are no others: its name is none of theirs."""
    others = [c for c in docs.columns if c not in plain]
    filler = "_" * (1 + max((len(c) for c in others), default=0))
    return docs.select(*plain, F.struct(*[named(c).alias(c) for c in others], F.lit(0).alias(filler)).alias("_others"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that ``packed_others`` was given, in their order."""
    return df.select(*[F.col(c) if c in df.columns and c != "_others" and c not in df.schema["_others"].dataType.names else F.col("_others")[c].alias(c) for c in columns])


def n_words() -> "F.Column":
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(NOT_SPACES)).cast("long")


# ---- numpy on Arrow text -------------------------------------------------------------------------------------------


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and each row's start in it with the end last; a null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch | pa.Table, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` text bytes (one row at least), which bounds the arrays made of them."""
    if not batch.num_rows:
        return
    _, offs = packed(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def order_within(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Indices that sort ``h`` inside each run [bounds[i], bounds[i + 1]), one run after the other; equal values come in any order.

    Runs of about one length are the rows of a matrix: many short sorts take a fraction of the time of one by two keys.
    """
    out = np.empty(len(h), np.int64)
    size = np.diff(bounds)
    bits = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
    for b in np.unique(bits):
        some = np.flatnonzero((bits == b) & (size > 0))
        first, n = bounds[:-1][some][:, None], size[some][:, None]
        place = np.arange(1 << int(b))
        inside = place < n
        at = (first + place)[inside]
        rows = np.full(inside.shape, np.iinfo(np.uint64).max)
        rows[inside] = h[at]
        order = np.argsort(rows, axis=1)
        out[at] = (order + first)[order < n]  # what only fills a row up is left out, wherever it came
    return out


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of ``inside`` bytes; runs end where a row ends."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1


#: A pseudo-random number for each of 64 places in a string and each byte that may stand there, made by rule.
_PLACES = mix(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * PRIME)


def run_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run's bytes (or code points); runs are disjoint and in order.

    Every place has unrelated numbers for its bytes, so that strings made by exchanging or doubling parts don't collide.
    """
    if not len(s):
        return np.zeros(0, np.uint64)
    lengths = e - s
    where = np.arange(lengths.sum()) - np.repeat(np.r_[0, np.cumsum(lengths)[:-1]], lengths)
    own = data[np.repeat(s, lengths) + where]
    if own.dtype == np.uint8:
        values = _PLACES[((where & 63) << 8) | own]
        far = np.flatnonzero(where > 63)
        values[far] = mix(values[far] + (where[far] >> 6).astype(np.uint64) * PRIME)
    else:
        values = mix((where.astype(np.uint64) << np.uint64(32)) + own.astype(np.uint64) + np.uint64(1))
    return mix(np.add.reduceat(values, np.r_[0, np.cumsum(lengths)[:-1]]) + lengths.astype(np.uint64))


def byte_grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes (or code points), by doubling."""
    h, width, out, have = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if size & width:
            if out is None:
                out, have = h, width
            else:
                n = len(h) - have
                out, have = out[:n] * np.uint64(pow(int(PRIME), width, 1 << 64)) + h[have : have + n], have + width
        if width * 2 > size:
            return mix(out)
        h = h[: len(h) - width] * np.uint64(pow(int(PRIME), width, 1 << 64)) + h[width:]
        width *= 2


def shingle_hashes(words: np.ndarray, row: np.ndarray, size: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all windows of ``size`` words; a row with fewer words but one at least has one of all its words."""
    count = np.bincount(row, minlength=n_rows)
    first = np.r_[0, np.cumsum(count)[:-1]]
    out, rows = [], []
    if len(words) >= size:
        h = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            h = mix(h * PRIME + words[k : len(words) - size + 1 + k] + np.uint64(k))
        same = row[: len(h)] == row[size - 1 :]
        out.append(h[same])
        rows.append(row[: len(h)][same])
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        h = np.zeros(len(few), np.uint64)
        for k in range(size - 1):
            more = np.flatnonzero(count[few] > k)
            h[more] = mix(h[more] * PRIME + words[first[few[more]] + k] + np.uint64(k))
        out.append(mix(h + count[few].astype(np.uint64)))
        rows.append(few)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, rows = np.concatenate(out), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return h[order], rows[order]


def exact_shingles(column: pa.Array, size: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers of each text's shingles of ``size`` words, and where each text's begin: within one call equal
    numbers are equal words. Words are numbered by comparing their bytes, shingles by numbering the words so far and the next."""
    data, offs = packed(column)
    data = LOWER[data] if lower else data
    s, e, row = runs(~SPACE[data], offs)
    n = len(offs) - 1
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    length = e - s
    own = data[np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(s, length)]
    words = binaries(own, np.r_[0, np.cumsum(length)]).dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    base = int(words.max()) + 1
    count = np.bincount(row, minlength=n)
    code = words
    for k in range(1, size):
        # where a text has no k-th word behind, 0 stands for it
        after = np.zeros(len(words), np.int64)
        after[: len(words) - k] = np.where(row[k:] == row[: len(words) - k], words[k:], 0)
        code = code * base + after
        if k + 1 < size:
            code = np.unique(code, return_inverse=True)[1]
    first = (np.cumsum(count) - count)[row]
    full = (np.arange(len(words)) - first <= count[row] - size) | ((count[row] < size) & (np.arange(len(words)) == first))
    h, rows = distinct_in_rows(code[full].astype(np.uint64), row[full])
    return h, np.searchsorted(rows, np.arange(n + 1))


def distinct_in_rows(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), sorted by both."""
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return h[new], rows[new]


def fresh_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose i-th value is ``data[bounds[i]:bounds[i + 1]]`` as bytes."""
    width = data.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64) * width), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
