"""What the corpus operators share: stored tables, word hashing in batches, and connected components.

Words are runs of anything but the six separators (space and U+0009 to U+000D). They are hashed on the UTF-8
bytes of a whole batch at once, so that Python never touches a single word.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a shingle and the similarity from which texts count as near-duplicates.
SHINGLE = 5
SIMILARITY_PERCENT = 80

#: Bytes of text that are hashed at a time; bounds the working memory of a task.
CHUNK_BYTES = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_COEF = [int(x) | 1 for x in np.random.default_rng(12345).integers(1 << 62, 1 << 63, 8)]
_BASE = 0xD6E8FEB86659FD93
_M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder, whatever file system it is in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, rows_of_file: int = 0) -> DataFrame:
    """Cuts the lineage: df written as a table in the shared folder and read again. Files hold rows_of_file rows at most
    (0: any number): large rows that a task reads go to Python together, outside the heap."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.option("maxRecordsPerFile", rows_of_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents_of(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone (and the columns asked for), so that extra columns with clashing names do no harm."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
#: The same with all ASCII characters but letters and digits as separators.
NOT_ALPHANUMERIC = np.array([x < 128 and not chr(x).isalnum() for x in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        _powers[:] = [
            np.cumprod(np.append(np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)), dtype=np.uint64)
            for b in (_BASE, pow(_BASE, -1, 1 << 64))
        ]
    return _powers


def give_back() -> None:
    """Hands memory that is free, or quick to make again, back to the system."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps what is freed below a block in use
        trim(0)


def giving_back(run: Callable, *also: Callable) -> Callable:
    """run, for mapInArrow(), and give_back() at the end of each task, after what `also` drops: Python workers stay
    beside their executor for a minute, also while stages without Python need its memory."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            for drop in also:
                drop()
            give_back()

    return task


def words(data: bytes, lower: bool = False, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and 64-bit hashes of the words of UTF-8 data."""
    b = np.frombuffer(data, np.uint8)
    if lower:
        b = _LOWER[b]
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~separator[b]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[0::2], edges[1::2]
    return starts, ends, hashes_of(b, starts, ends)


def hashes_of(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers_to(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _MULT)


def each_text(
    texts: list, lower: bool = False, separator: np.ndarray = _SEPARATOR
) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text (null: empty) its number, bytes, and the starts, ends and hashes of its words."""
    pending: list[tuple[int, bytes]] = []
    size = 0

    def flush():
        data = b" ".join(x for _, x in pending)
        starts, ends, h = words(data, lower, separator)
        at = 0
        for i, x in pending:
            lo, hi = np.searchsorted(starts, (at, at + len(x)))
            yield i, x, starts[lo:hi] - at, ends[lo:hi] - at, h[lo:hi]
            at += len(x) + 1

    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        pending.append((i, data))
        size += len(data)
        if size >= CHUNK_BYTES:
            yield from flush()
            pending, size = [], 0
    if pending:
        yield from flush()


def each_chunk(texts: list, lower: bool = False, least: int = 0) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Texts some at a time: their numbers, the hashes of all their words in turn, and where each text's words begin
    (and, at last, end). Texts of fewer than `least` words are left out."""
    pending: list[tuple[int, np.ndarray]] = []
    size = 0
    for i, _, _, _, h in each_text(texts, lower):
        if len(h) < least:
            continue
        pending.append((i, h))
        size += len(h)
        if size > CHUNK_BYTES // 8:
            yield [i for i, _ in pending], np.concatenate([h for _, h in pending]), np.cumsum([0, *(len(h) for _, h in pending)])
            pending, size = [], 0
    if pending:
        yield [i for i, _ in pending], np.concatenate([h for _, h in pending]), np.cumsum([0, *(len(h) for _, h in pending)])


def shingles(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the k-word shingles in text order; a shorter sequence counts as one; no words: none."""
    n = len(h)
    if n == 0:
        return h
    if n < k:
        total = n * 0xA24BAED4963EE407
        for c, x in zip(_COEF, h.tolist()):
            total += c * x
        return mix(np.array([total & _M64], np.uint64))
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        total += h[j : n - k + 1 + j] * np.uint64(_COEF[j])
    return mix(total)


def content_hash(h: np.ndarray) -> int:
    """A signed 64-bit hash of a whole array of hashes."""
    import xxhash

    x = xxhash.xxh3_64_intdigest(np.ascontiguousarray(h).tobytes())
    return x - (1 << 64) if x >> 63 else x


def identity(h: np.ndarray) -> bytes:
    """A 128-bit hash of a whole array of hashes: at any number of texts, equal identities are equal texts."""
    import xxhash

    return xxhash.xxh3_128_digest(np.ascontiguousarray(h).tobytes())


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def records(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def runs(batches, *keys: str) -> Iterator[pa.Table]:
    """The rows of each run of equal keys (whole numbers without nulls), one run in memory at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        if held and (k[:, 0] != last).any():
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = k[:, -1]
    if held:
        yield pa.Table.from_batches(held)


def whole_runs(batches, *keys: str, least: int = 4096) -> Iterator[pa.Table]:
    """Some whole runs of equal keys at a time, of `least` rows together or more but for the last."""
    held: list[pa.RecordBatch] = []
    n, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in keys])
        cuts = [0] * bool(last is not None and (k[:, 0] != last).any()) + (np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist()
        if cuts and n + cuts[-1] >= least:
            yield pa.Table.from_batches([*held, batch.slice(0, cuts[-1])])
            held, n = [batch.slice(cuts[-1])], batch.num_rows - cuts[-1]
        else:
            held.append(batch)
            n += batch.num_rows
        last = k[:, -1]
    if held:
        yield pa.Table.from_batches(held)


def frequent_shingles(docs: DataFrame, sample: int = 4096, least: int = 4, most: int = 200_000) -> np.ndarray:
    """The sorted hashes of shingles that at least this many documents of a hash sample of about `sample` hold, the
    most frequent ones. They come last in orders of shingles, which keeps groups of unrelated documents small;
    any order gives the same links."""
    total = docs.count()
    at = int(min(1.0, sample / max(total, 1)) * (1 << 30))
    schema = pa.schema([("token", pa.int64())])

    def run(batches):
        for batch in batches:
            for _, _, _, _, h in each_text(batch.column("text").to_pylist(), lower=True):
                yield records(schema, {"token": signed(np.unique(shingles(h, SHINGLE)))})

    few = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < at).select("text")
    counts = few.mapInArrow(giving_back(run), "token long").groupBy("token").count().where(F.col("count") >= least)
    top = counts.orderBy(F.desc("count"), "token").limit(most).select("token").toArrow()
    return np.sort(top["token"].to_numpy().view(np.uint64))


def is_in(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted values."""
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


#: Rows of a table of two numbers a row that may be broadcast: some 16 MB.
BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df (a stored table with few, narrow columns), marked for a broadcast if it has BROADCAST_ROWS rows at most."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Bits of the map with which rows are thinned out before a shuffle: 32 to 64 a key, between powers of these bounds.
MAP_BITS, MOST_MAP_BITS = 16, 28


def map_bits(n: int) -> int:
    return min(max(MAP_BITS, (64 * n).bit_length() - 1), MOST_MAP_BITS)


def key_map(keys: DataFrame, column: str, bits: int) -> bytes:
    """A bitmap of hashed keys, of 2**bits / 8 bytes, 32 MB at most. It only thins out rows before an exact join: at
    any size of the input it never drops a row that has a partner, and at worst lets all pass."""
    at = keys.select(F.pmod(F.col(column), F.lit(1 << bits)).alias("at"))
    rows = at.select(F.expr("shiftright(at, 5) AS w"), F.expr("shiftleft(1L, CAST(at % 32 AS int)) AS b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().astype(np.uint32)
    return out.tobytes()


def in_map(keys: np.ndarray, bitmap: bytes) -> np.ndarray:
    """Which of the signed 64-bit keys may be among those of key_map()."""
    bits = (len(bitmap) * 8).bit_length() - 1
    at = keys.view(np.uint64) & np.uint64((1 << bits) - 1)
    found = np.frombuffer(bitmap, np.uint32)[(at >> np.uint64(5)).astype(np.int64)]
    return (found >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) != 0


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node that links reach.

    Large-star and small-star steps in turn; each round is a grouped minimum and a join, and its edges are written
    to the shared folder, so a lost executor costs one round at most. Hubs are met with a map-side minimum, never
    with a collected neighbour list. No edges: no rows.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
        )).alias("x")).select("x.*").where("a <> b").distinct()
        e = stored(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b")).distinct()
