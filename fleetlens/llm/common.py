"""What the operators of this subpackage share: scratch tables, Arrow passes, vectorised word hashes, components."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side may be broadcast if its rows take at most so many bytes in a task's hash table.
BROADCAST_BYTES = 32 << 20
#: Texts are worked on in chunks of about so many bytes; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch, which a worker holds whole; one longer row is a batch of its own.
BATCH_BYTES = 4 << 20
#: A worker gives memory back to the system after so many bytes of batches, and at a task's end.
TRIM_BYTES = 32 << 20
#: Java's class for what ends a word: space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"

_folders: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir, which every executor sees. Only a local session may lack that setting; it gets a temporary folder."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir isn't set: it has to name a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="fleetlens-")
        _folders[app] = f"{base.rstrip('/')}/fleetlens-{app}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone already
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: lineage ends here, and a lost executor costs no more than a new read."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more: what was made from them has been written."""
    for t in tables:
        _remove(t.sparkSession, t.scratch_path)


def row_bytes(df: DataFrame) -> int:
    """What a row takes in a hash table, about: its head, 8 bytes a number, 48 a text."""
    return 48 + sum(48 if f.dataType.typeName() in ("string", "array", "struct", "map", "binary") else 8 for f in df.schema)


def within(df: DataFrame, limit: int | None = None) -> bool:
    """Whether df is small enough to be broadcast, by BROADCAST_BYTES and, if given, a limit of rows; counted no further than that."""
    most = BROADCAST_BYTES // row_bytes(df)
    most = most if limit is None else min(limit, most)
    return df.limit(most + 1).count() <= most


def sent(df: DataFrame, limit: int | None = None) -> DataFrame:
    """df marked for broadcast if it is small enough, else as it is."""
    return F.broadcast(df) if within(df, limit) else df


def keep_ids(df: DataFrame, ids: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join with a table of ids: broadcast if its counted size allows it, else by shuffle."""
    return df.join(sent(ids), on, how)


def arrow_pass(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict | pa.RecordBatch]]], schema: str, size: int | None = None) -> DataFrame:
    """mapInArrow over slices of at most about `size` bytes of data, else CHUNK_BYTES; make() is called once a task and may hold the task's state.

    Its function may have an attribute `finish`, a generator function for what remains at a task's end."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return arrow_rows(df, make, to_arrow_schema(_parse_datatype_string(schema)), schema, size)


def arrow_rows(df: DataFrame, make, kind: pa.Schema, schema, size: int | None = None) -> DataFrame:
    """arrow_pass for an Arrow schema. Batches are bounded in bytes by a setting of the session, which is made here unless the caller has made it."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, BATCH_BYTES)
    return df.mapInArrow(arrow_runner(make, kind, size), schema)


def arrow_runner(make, kind: pa.Schema, size: int | None = None):
    def run(batches):
        step, worked = make(), 0

        def out(x):
            if isinstance(x, pa.RecordBatch):
                return x
            return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for f, v in zip(kind, x.values(), strict=True)], schema=kind)

        for batch in batches:
            worked += batch.nbytes
            for piece in slices(batch, size):
                for x in step(piece):
                    yield out(x)
            if worked > TRIM_BYTES:
                worked = 0
                give_back()
        if hasattr(step, "finish"):
            for x in step.finish():
                yield out(x)
        del step
        give_back()

    return run


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on for other tasks, and what it keeps its executor lacks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, size: int | None = None) -> Iterator[pa.RecordBatch]:
    n, size = batch.num_rows, size or CHUNK_BYTES
    if not n:
        return
    rows = max(1, int(n * size / max(1, batch.nbytes)))
    at = 0
    while at < n:
        piece = batch.slice(at, rows)
        while piece.num_rows > 1 and _bytes(piece) > 4 * size:
            piece = piece.slice(0, piece.num_rows // 2)
        yield piece
        at += piece.num_rows


def _bytes(batch: pa.RecordBatch) -> int:
    total = 0
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            o = np.frombuffer(c.buffers()[1], np.int32)
            total += int(o[c.offset + len(c)] - o[c.offset])
    return total


def column_bytes(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets; null counts as empty."""
    if pa.types.is_large_string(c.type):
        c = c.cast(pa.string())
    if c.null_count:
        c = c.fill_null("")
    offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
    data = np.frombuffer(c.buffers()[2], np.uint8) if c.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240601)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M = 0x9E3779B97F4A7C15 | 1
_MI = pow(_M, -1, 1 << 64)
#: Powers for chunks of usual length are kept; those for a longer text are made for it alone.
_KEPT = 1 << 20
_pow: list[np.ndarray] = []


def _made(n: int) -> list[np.ndarray]:
    out = []
    for m in (_M, _MI):
        x = np.full(n, np.uint64(m))
        x[:1] = 1
        out.append(np.multiply.accumulate(x))
    return out


def _powers(n: int) -> list[np.ndarray]:
    if n > _KEPT:
        return _made(n)
    if not _pow:
        _pow.extend(_made(_KEPT))
    return _pow


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_starts(data: np.ndarray, offsets: np.ndarray, stop: np.ndarray = _SPACE) -> np.ndarray:
    """Where words start: a word is a run of bytes outside `stop`; it ends with its text."""
    if not len(data):
        return np.zeros(0, np.int64)
    word = ~stop[data]
    head = word.copy()
    head[1:] &= ~word[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    head[first] = word[first]
    return np.flatnonzero(head)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False, stop: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Of the words of many texts that lie one after the other: 64-bit hashes, and n+1 offsets of each text's words."""
    n = len(data)
    starts = word_starts(data, offsets, stop)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~stop[data]
    p, pi = _powers(n)
    x = _BYTE[_LOWER[data] if lower else data]
    x *= p[:n]
    x[~word] = 0
    h = mix(np.add.reduceat(x, starts) * pi[starts])
    return h, np.searchsorted(starts, offsets)


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each run of width values of h, which may cross from one text into the next."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.uint64)
    p, pi = _powers(n + 1)
    s = np.zeros(n + 1, np.uint64)
    np.add.accumulate(h * p[:n], out=s[1:])
    return mix((s[width:] - s[:-width]) * pi[: n - width + 1])


def text_of(offsets: np.ndarray) -> np.ndarray:
    """For n+1 offsets, the text that each item belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as sorted hashes and n+1 offsets; a text of fewer words is one shingle, one without words none. A-Z count as a-z."""
    h, at = word_hashes(data, offsets, lower=True)
    n = np.diff(at)
    doc = text_of(at)
    r = rolling(h, width)
    ok = doc[: len(r)] == doc[width - 1 :] if len(r) else np.zeros(0, bool)
    d, r = doc[: len(r)][ok], r[ok]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        p, pi = _powers(width + 1)
        own = np.array([mix(np.sum(h[at[i] : at[i + 1]] * p[: n[i]], keepdims=True))[0] for i in short], np.uint64)
        d, r = np.concatenate((d, short)), np.concatenate((r, own ^ n[short].astype(np.uint64)))
    order = np.lexsort((r, d))
    d, r = d[order], r[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (d[1:] != d[:-1])
    d, r = d[new], r[new]
    return r, np.searchsorted(d, np.arange(len(offsets)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of links (a, b), written: the smallest node reachable. Large-star and small-star rounds, each cut by a written table.

    A node with very many links meets its least neighbour through a broadcast, or, where there are too many nodes for
    that, in a join whose sides are both plain exchanges, so that its rows can be split."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before, now, done = None, _print(edges), []
    while now[0] and now != before:
        few = 2 * now[0] <= BROADCAST_BYTES // row_bytes(edges)

        def met(rows: DataFrame, low: DataFrame) -> DataFrame:
            if few:  # noqa: B023  used in this round only
                return rows.join(F.broadcast(low), "a")
            done.append(written(low, name))
            return rows.join(done[-1], "a")

        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = written(met(both, low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), name)
        pair = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        after = written(met(large, large.groupBy("a").agg(F.min("b").alias("m"))).select(F.explode(pair).alias("e")).select("e.a", "e.b").where("a <> b").distinct(), name)
        release(edges, large, *done)
        edges, before, now, done = after, now, _print(after), []
    found = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out = written(found, name)
    release(edges)
    return out


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
