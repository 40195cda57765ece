"""Benchmark decontamination: MinHash containment search over size partitions of the test items.

The shingle of a test item with the least value of a hash function lies in a document with a chance
equal to the item's containment in it, whatever the document's length. So an item's signature holds
those shingles, one for each hash function, and the number of functions that hit a document estimates
the containment. (Min-hashes of whole documents can't be compared: a 30-word item in a 20,000-word
document has a Jaccard similarity near 0.001.)

Items are partitioned by the size of their shingle set; each partition has its own number of hash
functions and its own least number of hits, the most that an item at the threshold reaches but for a
chance of ``MISS``. In the smallest partition the whole set is the signature and the least number is exact.
Candidates are verified by the exact containment of the item's shingles in the document's.

Items are a query set: they are sent to the tasks in blocks of bounded size, all documents against
each block, in one pass over the documents and without a shuffle.

Defined results: null, empty and word-less texts on either side match nothing; an item of fewer than
five words is one shingle of all its words, which only a document of the same words holds; null ids
stay null; ids are of any type; equal rows count once; empty tables give an empty result.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkseg.llm.base import SHINGLE_WORDS, SIMILARITY_PERCENT, Scratch, in_arrow, mix, shingle_sets, without_ids

#: Largest set size and hash functions of each partition; without functions the whole set is the signature.
PARTITIONS = ((32, 0), (128, 32), (1024, 64), (math.inf, 128))
#: Chance that an item at the threshold has fewer hits than its partition asks for.
MISS = 1e-9
#: Shingles in a block of items (8 bytes each); a block is what a task holds at once.
BLOCK_SHINGLES = 1_000_000


def least_hits(hashes: int, percent: int, miss: float = MISS) -> int:
    """The most hits that ``hashes`` functions reach at a containment of ``percent``, but for a chance of ``miss``."""
    p, below, k = percent / 100, 0.0, 0
    while k < hashes:
        below += math.comb(hashes, k) * p**k * (1 - p) ** (hashes - k)
        if below > miss:
            break
        k += 1
    return max(1, k)


def signature(shingles: np.ndarray, percent: int, partitions=PARTITIONS) -> tuple[np.ndarray, np.ndarray, int]:
    """The distinct shingles that stand for a set, how many functions chose each, and the least number of hits."""
    hashes = partitions[bisect.bisect_left([most for most, _ in partitions], len(shingles))][1]
    if not hashes:
        return shingles, np.ones(len(shingles), np.int64), max(1, -(-percent * len(shingles) // 100))
    salts = mix(np.arange(1, hashes + 1, dtype=np.uint64))
    chosen, times = np.unique(shingles[[int(mix(shingles ^ salt).argmin()) for salt in salts]], return_counts=True)
    return chosen, times, least_hits(hashes, percent)


class Block:
    """Some items' shingle sets, with postings from signature shingles to items."""

    def __init__(self, items: list[tuple], percent: int):
        self.ids = [i for i, _ in items]
        self.sets = [s for _, s in items]
        self.percent = percent
        signatures = [signature(s, percent) for s in self.sets]
        keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, _, _ in signatures)])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.owner = np.repeat(np.arange(len(items)), [len(k) for k, _, _ in signatures])[order]
        self.times = np.concatenate([np.zeros(0, np.int64), *(t for _, t, _ in signatures)])[order]
        self.least = np.array([h for _, _, h in signatures], np.int64)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def candidates(self, doc: np.ndarray) -> np.ndarray:
        """Items with enough hits in a document's shingles."""
        held = doc[self.maybe[(doc & np.uint64(0xFFFF)).astype(np.int64)]]
        a, b = np.searchsorted(self.keys, held, "left"), np.searchsorted(self.keys, held, "right")
        if not (b > a).any():
            return np.zeros(0, np.int64)
        sizes = b - a
        at = np.arange(int(sizes.sum())) + np.repeat(a - (np.cumsum(sizes) - sizes), sizes)
        met, which = np.unique(self.owner[at], return_inverse=True)
        return met[np.bincount(which, self.times[at]) >= self.least[met]]

    def search(self, doc: np.ndarray):
        """Items that the document contains: position, shared shingles."""
        for k in self.candidates(doc).tolist():
            item = self.sets[k]
            at = np.searchsorted(doc, item)
            at[at == len(doc)] = 0
            shared = int((doc[at] == item).sum())
            if 100 * shared >= self.percent * len(item):
                yield k, shared


def _item_sets(width: int):
    def run(batches):
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column("text").to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(sets, pa.binary())], ["item_id", "shingles"])

    return run


def _search(block, width: int, item_type: pa.DataType):
    def run(batches):
        items = block.value
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                found = [(r, k, n) for r, doc in enumerate(shingle_sets(part.column("text").to_pylist(), width)) if len(doc) for k, n in items.search(doc)]
                rows, which, shared = ([x[i] for x in found] for i in range(3))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array([items.ids[k] for k in which], item_type), pa.array([len(items.sets[k]) for k in which], pa.int64()), pa.array(shared, pa.int64())],
                    ["doc_id", "item_id", "n_item", "n_shared"],
                )

    return run


def _blocks(items: DataFrame, limit: int, percent: int):
    """Items a block at a time: the driver holds no more than one."""
    block, held = [], 0
    for row in items.toLocalIterator(prefetchPartitions=False):
        s = np.frombuffer(bytes(row.shingles), dtype=np.uint64)
        if held + len(s) > limit and block:
            yield Block(block, percent)
            block, held = [], 0
        block.append((row.item_id, s))
        held += len(s)
    yield Block(block, percent)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared, containment``: a row for each item that a document contains."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    item_type = benchmark.schema[item_key].dataType
    items = benchmark.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    items = items.transform(in_arrow, _item_sets(width), f"item_id {item_type.simpleString()}, shingles binary").where("length(shingles) > 0")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {kind}, item_id {item_type.simpleString()}, n_item long, n_shared long"
    scratch, written, last = Scratch(spark, "decontam"), [], None
    for block in _blocks(items, block_shingles, percent):
        if last is not None:  # more than one block: each one's result is a written table
            written.append(scratch.table(last, "found"))
        last = rows.transform(in_arrow, _search(spark.sparkContext.broadcast(block), width, to_arrow_type(item_type)), schema)
    for w in written:
        last = last.unionByName(w)
    return last.distinct().withColumn("containment", F.col("n_shared") / F.col("n_item"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose document contains no test item, with all their columns."""
    found = contaminated(docs, benchmark, key, **options).select(F.col("doc_id").alias("id_")).distinct()
    return without_ids(docs, key, Scratch(docs.sparkSession, "contaminated").table(found, "found"), "id_")


ORACLE_SQL = r"""
WITH src AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT kind, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM src),
s AS (SELECT kind, id, list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS sh FROM w WHERE len(ws) > 0),
e AS (SELECT kind, id, len(sh) AS n, unnest(sh) AS g FROM s)
SELECT d.id AS doc_id, b.id AS item_id, CAST(b.n AS BIGINT) AS n_item, count(*) AS n_shared, count(*) / CAST(b.n AS DOUBLE) AS containment
FROM e b JOIN e d ON b.g = d.g AND b.kind = 'b' AND d.kind = 'd'
GROUP BY d.id, b.id, b.n HAVING 100 * count(*) >= 75 * b.n
"""
