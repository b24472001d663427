"""What the text operators share: tables, tokens, byte-level numpy helpers and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text; NULL has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only in local mode (tests) a temporary one if none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='paddock-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


SCOPES: list[list] = []  # what the open `scratch` blocks have made


def written(df: DataFrame, kind: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, which outlives any executor; it goes with `scratch`."""
    path = f"{shared_folder(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if SCOPES:
        SCOPES[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared(spark: SparkSession, value):
    """A broadcast variable that is released with `scratch`."""
    made = spark.sparkContext.broadcast(value)
    if SCOPES:
        SCOPES[-1].append(made)
    return made


@contextmanager
def scratch(spark: SparkSession):
    """Tables and broadcasts that operators make inside go at the end, so what is read from them must be written by then.

    Operators return lazy results; outside such a block their tables stay in the shared folder.
    """
    SCOPES.append([])
    try:
        yield
    finally:
        for made in SCOPES.pop():
            if isinstance(made, str):
                path = spark._jvm.org.apache.hadoop.fs.Path(made)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            else:
                made.unpersist()


def unused(name: str, columns: list[str]) -> str:
    """`name`, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def any_names(stage):
    """A function of documents that also takes columns whose names have dots or backticks, which Arrow tasks can't be given."""

    @wraps(stage)
    def run(docs: DataFrame, *args, **how) -> DataFrame:
        spare: dict[str, str] = {}
        for c in docs.columns:
            if "." in c or "`" in c:
                spare[c] = unused("column", [*docs.columns, *spare.values()])
        made = stage(docs.withColumnsRenamed(spare) if spare else docs, *args, **how)
        return made.withColumnsRenamed({v: c for c, v in spare.items()}) if spare else made

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- byte-level helpers that run inside tasks ---

SLICE_BYTES = 1 << 18  # so that the arrays of a slice are small and stay in the cache


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the texts of a slice hold about `limit` bytes; a longer text comes alone."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        if not len(sizes):
            continue
        bins = np.cumsum(sizes.astype(np.int64)) // limit
        edges = np.flatnonzero(np.diff(bins)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(sizes)], strict=True):
            yield batch.slice(a, b - a)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); NULL is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if column.offset or not len(column):
        column = pa.concat_arrays([column]) if len(column) and not column.offset else pa.array(column.to_pylist(), pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@lru_cache(4)
def byte_codes(seed: int = 20240229) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hash(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every k-byte string, by doubling; from 8 bytes on the windows are read as machine words.

    The last step lets two windows overlap, so k need not be a power of two.
    """
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k >= 8:
        data = np.ascontiguousarray(data)
        out, run = mix(np.ndarray(len(data) - 7, np.dtype("<u8"), data, strides=(1,))), 8
    else:
        out, run = byte_codes()[data], 1
    while run < k:
        step = min(run, k - run)
        out = out[:-step] * BASE + out[step:]
        out ^= out >> np.uint64(29)
        run += step
    return out if k == 8 else mix(out)


BLOCK = 1 << 17  # machine words hashed at once
HEADS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)  # of the first bytes of a machine word


class RangeHash:
    """64-bit hashes of arbitrary byte ranges.

    The machine words of a range are mixed, multiplied by odd numbers that depend on their place in the range, and
    summed. No relation between words survives the mixing, so unlike ranges of any length meet by chance only.
    The words are taken block by block, so ranges of any length need the same memory.
    """

    def __init__(self, data: np.ndarray, seed: int = 20240229):
        self.padded, self.seed = np.concatenate([data, np.zeros(8, np.uint8)]), mix(np.array([seed], np.uint64))
        self.words = np.ndarray(len(data) + 1, np.dtype("<u8"), self.padded, strides=(1,))

    def mixed(self, places: np.ndarray, sizes: np.ndarray, steps: np.ndarray | int) -> np.ndarray:
        """The first `sizes` (8 at most) bytes at places, as the words number `steps` of their ranges."""
        odd = mix(np.atleast_1d(np.asarray(steps, np.uint64)) + self.seed) | np.uint64(1)
        return mix((self.words[places] & HEADS[sizes]) ^ (self.seed + sizes.astype(np.uint64))) * odd

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of [start, end), which may overlap and stand in any order."""
        sizes = np.asarray(ends - starts, np.int64)
        long = np.flatnonzero(sizes > 8)
        if not len(long):
            return mix(self.mixed(starts, sizes, 0) ^ self.seed)
        out = np.empty(len(sizes), np.uint64)
        short = np.flatnonzero(sizes <= 8)
        out[short] = self.mixed(starts[short], sizes[short], 0)
        out[long] = self.summed(starts[long], sizes[long])
        return mix(out ^ self.seed)

    def summed(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out, words = np.zeros(len(sizes), np.uint64), (sizes + 7) >> 3
        upto = np.cumsum(words)
        first, total = 0, int(upto[-1])
        for at in range(0, total, BLOCK):
            stop = min(at + BLOCK, total)
            last = int(np.searchsorted(upto, stop))
            begin = upto[first : last + 1] - words[first : last + 1]
            counts = np.minimum(upto[first : last + 1], stop) - np.maximum(begin, at)
            some = np.flatnonzero(counts > 0)
            of, counts = first + some, counts[some]
            step = np.arange(at, stop) - np.repeat(upto[of] - words[of], counts)
            of = np.repeat(of, counts)
            out[first + some] += np.add.reduceat(self.mixed(starts[of] + 8 * step, np.minimum(sizes[of] - 8 * step, 8), step), np.cumsum(counts) - counts)
            first = last
        return out


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True that end at the text boundaries in `offsets`."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], mask[:-1]]) if len(mask) else mask
    starts = np.flatnonzero(mask & (~before | edge[:-1]))
    after = np.concatenate([mask[1:], [False]]) if len(mask) else mask
    return starts, np.flatnonzero(mask & (~after | edge[1:])) + 1


def marked(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are marked."""
    edges = offsets.tolist()
    return np.array([np.count_nonzero(mask[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], np.int64)


def any_in(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each of the rising, separate, non-empty ranges has a marked byte."""
    edges = np.stack([starts, ends], axis=1).reshape(-1)
    if len(edges) and edges[-1] == len(mask):
        edges = edges[:-1]
    return np.logical_or.reduceat(mask, edges)[::2] if len(edges) else np.zeros(0, bool)


def counts_between(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the sorted points fall into each text."""
    return np.diff(np.searchsorted(points, offsets))


def bloom(keys: DataFrame, most_bits: int = 1 << 27):
    """Broadcast bit array of the bigint column of `keys`: 16 bits a key, `most_bits` (16 MB) at most.

    A prefilter before an exact join: too many keys only let more rows through.
    """
    (name,) = keys.columns
    bits = min(most_bits, 1 << max(10, (16 * max(1, keys.count()) - 1).bit_length()))
    places = keys.select(F.explode(F.array(*[F.pmod(F.xxhash64(F.col(name), F.lit(k)), F.lit(bits)) for k in range(2)])).alias("p"))
    ored = places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    words = np.zeros(bits >> 6, np.int64)
    words[ored.column("word").to_numpy()] = ored.column("b").to_numpy()
    return shared(keys.sparkSession, words)


def spark_xxhash64(values: np.ndarray, k: int) -> np.ndarray:
    """Spark's xxhash64(bigint value, int k) for a whole array."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    with np.errstate(over="ignore"):
        h = np.uint64(42) + p5 + np.uint64(8)
        h = h ^ (turn(values.view(np.uint64) * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = end = (h ^ (h >> np.uint64(33))) * p2
        h = end = (end ^ (end >> np.uint64(29))) * p3
        h = end ^ (end >> np.uint64(32))
        h = h + p5 + np.uint64(4)
        h = h ^ (np.uint64(k) * p1)
        h = turn(h, 23) * p2 + p3
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def may_hold(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value may be among the keys of a `bloom`."""
    out = np.ones(len(values), bool)
    for k in range(2):
        at = spark_xxhash64(values, k) & np.int64(len(words) * 64 - 1)
        out &= (words[at >> 6] >> (at & 63)) & 1 == 1
    return out
