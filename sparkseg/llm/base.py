"""What several operators share: scratch tables, table reading, word shingles."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 75

_LOCAL: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see, from ``spark.checkpoint.dir``.

    Where the session has none, a local master gets a folder of this machine; a cluster gets an error,
    since its executors couldn't see such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="sparkseg-"))
    return _LOCAL[0]


#: Rows and bytes of an Arrow batch: what a task's Python side holds of its input at once.
BATCH_ROWS = 1_000
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python by rows and bytes, where the session allows more."""
    for setting, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(setting)).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(setting, str(most))


def give_back() -> None:
    """Hand freed memory back to the machine; a worker lives on after its task, the driver after a fit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass


def tidy(run: Callable) -> Callable:
    """A function of batches that gives freed memory back when its task ends."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def in_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` over the Arrow batches of ``df``, which are small, with memory given back at each task's end."""
    small_batches(df.sparkSession)
    return df.mapInArrow(tidy(run), schema)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of these frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Makes Spark delete the shuffle files of a finished execution at once, not when the driver's heap is next collected.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written tables in the shared folder; they cut lineage and outlive a lost executor.

    Intermediate tables go with ``drop``; the others when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.drop)

    def new(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.new(name)
        schema = df.schema
        before = self.spark.conf.get(SHUFFLES_GO, None)
        self.spark.conf.set(SHUFFLES_GO, "true")  # the table is read from its files, so what was shuffled for it isn't needed again
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(SHUFFLES_GO) if before is None else self.spark.conf.set(SHUFFLES_GO, before)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables, or without arguments all of them."""
        try:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            for p in [t._scratch_path for t in tables] or [self.path]:
                path = jvm.org.apache.hadoop.fs.Path(p)
                path.getFileSystem(conf).delete(path, True)
        except Exception:  # the session has ended; its folder goes with the cluster's clean-up
            if tables:
                raise


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased; other letters stay as they are."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []  # of bytes: ASCII alone


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


#: A random number for each byte, and which bytes are white space.
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_IS_WHITE = np.isin(np.arange(256), [32, *range(9, 14)])
#: Bytes whose words are hashed at once.
HASHED_BYTES = 1 << 20
_places = mix(np.arange(1000, 1064, dtype=np.uint64)) | np.uint64(1)


def _place_factors(longest: int) -> np.ndarray:
    """A random odd number for each place in a word."""
    global _places
    if longest <= len(_places):
        return _places
    factors = mix(np.arange(1000, 1000 + longest, dtype=np.uint64)) | np.uint64(1)
    if longest <= 1 << 16:
        _places = factors
    return factors


def _hash_block(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the words of some bytes: the sum of each byte's number times its place's."""
    inside = np.concatenate([[False], ~_IS_WHITE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    offsets = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(offsets, sizes)
    with np.errstate(over="ignore"):
        values = _BYTES[data[inside[1:-1]]] * _place_factors(int(sizes.max()))[place]
        return starts, mix(np.add.reduceat(values, offsets) + sizes.astype(np.uint64) * _MULTIPLIER)


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """64-bit hashes of each text's words, A-Z lower-cased, the same in every process."""
    encoded = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = b" ".join(encoded).lower()
    ends = np.cumsum([len(e) + 1 for e in encoded])
    places, found, at = [], [], 0
    while at < len(data):
        stop = min(at + HASHED_BYTES, len(data))
        while stop < len(data) and not _IS_WHITE[data[stop]]:  # a block ends between words
            stop += 1
        starts, hashes = _hash_block(np.frombuffer(data, np.uint8, stop - at, at))
        places.append(starts + at)
        found.append(hashes)
        at = stop
    cuts = np.searchsorted(np.concatenate(places), ends[:-1]) if places else np.zeros(max(0, len(texts) - 1), np.int64)
    return np.split(np.concatenate(found) if found else np.zeros(0, np.uint64), cuts) if texts else []


def window_hashes(hashes: np.ndarray, width: int = SHINGLE_WORDS) -> np.ndarray:
    """A hash for each run of ``width`` words; for fewer words one hash of all of them, for none nothing."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(n, width)
    with np.errstate(over="ignore"):
        out = hashes[: n - width + 1] + np.uint64(width)
        for i in range(1, width):
            out *= _MULTIPLIER
            out += hashes[i : n - width + 1 + i]
        return mix(out)


def shingle_sets(texts: list[str | None], width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each whole text."""
    return [np.unique(window_hashes(h, width)) for h in word_hashes(texts)]


#: The filter of ids: a fixed size, 2**18 words of 64 bits. Where it fills up it lets more rows pass, never fewer.
FILTER_BITS = 24


def id_hash(key):
    """A hash of an id of any type; null has one too."""
    return F.xxhash64(F.coalesce(key.cast("string"), F.lit("~")))


def _word(h):
    return F.shiftrightunsigned(h, 64 - FILTER_BITS + 6)


def _bit(h):
    return F.shiftrightunsigned(h, 64 - FILTER_BITS).bitwiseAND(F.lit(63)).cast("int")


def id_filter(ids: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """A bit table of fixed size, ``word_, bits_``, with a bit for each id; few enough rows to broadcast."""
    words = ids.select(id_hash(ids[key]).alias("h")).select(_word(F.col("h")).alias("word_"), _bit(F.col("h")).alias("bit"))
    return scratch.table(words.groupBy("word_").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits_")), "id-filter")


def split_by_ids(rows: DataFrame, key: str, ids: DataFrame, ids_key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose id is surely none of ``ids``, and those whose id may be; without a shuffle of rows."""
    words = id_filter(ids, ids_key, Scratch(rows.sparkSession, "id-filter"))
    h = id_hash(rows[key])
    held = (_word(h) == words["word_"]) & (F.getbit(words["bits_"], _bit(h)) == 1)
    surely_not, maybe = (rows.join(F.broadcast(words), held, how) for how in ("left_anti", "left_semi"))
    return surely_not, maybe


def without_ids(rows: DataFrame, key: str, ids: DataFrame, ids_key: str) -> DataFrame:
    """Rows whose id isn't among ``ids``; only rows that the filter lets pass are shuffled."""
    surely_not, maybe = split_by_ids(rows, key, ids, ids_key)
    gone = ids.select(F.col(ids_key).alias("gone_id_"))
    return surely_not.unionByName(maybe.join(gone.hint("merge"), maybe[key].eqNullSafe(gone["gone_id_"]), "left_anti"))


def crc32_of(column: str):
    """crc32 of a column's text, as the folds of labelled rows use it."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
