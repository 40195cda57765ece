"""Exact deduplication by polynomial fingerprints that compose.

The fingerprint of a text is its bytes' polynomial in a fixed base modulo two primes. For a
concatenation xy it is ``f(x) * base**len(y) + f(y)``, so chunks of a huge document are hashed in
parallel and combined by length-shifted arithmetic. Texts with equal fingerprint and length are
then compared with their group's first text chunk by chunk; what differs forms a group of its own
and is compared again, so a collision can't merge two texts.

Defined results: null text counts as empty; texts are compared after each run of ASCII white space
became one space; null ids sort after all others and one row of a group of null ids stays; of rows
with the same id and text one stays; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseg.llm.base import Scratch, fresh, in_arrow, split_by_ids

#: Two primes below 2**31 and a base for each.
MODULI = (2147483647, 2147483629)
BASES = (911382323, 972663749)
CHUNK_BYTES = 16_384
#: Documents of more bytes are hashed chunk by chunk in different tasks.
HUGE_BYTES = 4 * CHUNK_BYTES


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


class Polynomial:
    """Fingerprints of byte strings of at most ``CHUNK_BYTES`` and their composition."""

    def __init__(self, moduli: tuple[int, int] = MODULI, bases: tuple[int, int] = BASES):
        self.moduli = moduli
        self.powers = []
        for m, b in zip(moduli, bases):
            p = [1]
            for _ in range(CHUNK_BYTES):
                p.append(p[-1] * b % m)
            self.powers.append(np.array(p[::-1], dtype=np.uint64))

    def chunk(self, data: np.ndarray) -> tuple[int, int]:
        values = data.astype(np.uint64) + np.uint64(1)
        return tuple(int(values @ p[CHUNK_BYTES - len(data) + 1 :]) % m for p, m in zip(self.powers, self.moduli))

    def shift(self, length: int) -> tuple[int, int]:
        """The factor by which what stands before ``length`` bytes moves up."""
        return tuple(int(p[CHUNK_BYTES - length]) for p in self.powers)

    def whole(self, data: np.ndarray) -> tuple[int, int]:
        a = b = 0
        for i in range(0, len(data), CHUNK_BYTES):
            part = data[i : i + CHUNK_BYTES]
            (x, y), (s, t) = self.chunk(part), self.shift(len(part))
            a, b = (a * s + x) % self.moduli[0], (b * t + y) % self.moduli[1]
        return a, b


def _slices(column: pa.Array):
    """Each value of a binary or string array as bytes in numpy, without a copy."""
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data or b"", dtype=np.uint8)
    return [data[at[i] : at[i + 1]] for i in range(len(column))]


def _hash_rows(moduli, bases):
    def run(batches):
        poly = Polynomial(moduli, bases)
        for batch in batches:
            found = [poly.whole(x) for x in _slices(batch.column("norm"))]
            rest = [c for c in batch.schema.names if c != "norm"]
            fp = pa.array([a << 31 | b for a, b in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), fp], [*rest, "fp"])

    return run


def _hash_chunks(moduli, bases):
    def run(batches):
        poly = Polynomial(moduli, bases)
        for batch in batches:
            parts = _slices(batch.column("chunk"))
            found, shifts = [poly.chunk(x) for x in parts], [poly.shift(len(x)) for x in parts]
            rest = [c for c in batch.schema.names if c != "chunk"]
            more = [pa.array([x[i] for x in y], pa.int64()) for y in (found, shifts) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *more], [*rest, "h0", "h1", "s0", "s1"])

    return run


def _chunks(column: str) -> Column:
    """A binary column as an array of chunks, at least one."""
    return F.expr(f"transform(sequence(0, greatest(0, cast((length({column}) - 1) div {CHUNK_BYTES} as int))), i -> substring({column}, i * {CHUNK_BYTES} + 1, {CHUNK_BYTES}))")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", moduli=MODULI, bases=BASES) -> DataFrame:
    """``doc_id, fp, n_bytes, sha256, copies``: a row for each distinct pair of id and text."""
    rows = docs.select(F.col(key).alias("doc_id"), normalised(F.col(text)).alias("norm"))
    rows = rows.withColumn("norm", F.col("norm").cast("binary")).withColumn("n_bytes", F.length("norm").cast("long"))
    kind = docs.schema[key].dataType.simpleString()
    keys = f"doc_id {kind}, n_bytes long, sha256 string"
    rows = rows.select("doc_id", "n_bytes", F.sha2("norm", 256).alias("sha256"), "norm")
    small = rows.where(F.col("n_bytes") <= HUGE_BYTES).transform(in_arrow, _hash_rows(moduli, bases), f"{keys}, fp long")
    small = small.groupBy("doc_id", "n_bytes", "sha256", "fp").agg(F.count("*").alias("copies"))
    pieces = rows.where(F.col("n_bytes") > HUGE_BYTES).select("doc_id", "n_bytes", "sha256", F.posexplode(_chunks("norm")).alias("idx", "chunk"))
    hashed = pieces.repartition("doc_id", "sha256", "idx").transform(in_arrow, _hash_chunks(moduli, bases), f"{keys}, idx int, h0 long, h1 long, s0 long, s1 long")
    m0, m1 = moduli
    huge = hashed.groupBy("doc_id", "n_bytes", "sha256").agg(
        F.array_sort(F.collect_set(F.struct("idx", "h0", "h1", "s0", "s1"))).alias("parts"), F.count_if(F.col("idx") == 0).alias("copies")
    )
    huge = huge.select("doc_id", "n_bytes", "sha256", F.expr(f"aggregate(parts, named_struct('a', 0L, 'b', 0L), (x, p) -> named_struct('a', (x.a * p.s0 + p.h0) % {m0}L, 'b', (x.b * p.s1 + p.h1) % {m1}L), x -> shiftleft(x.a, 31) | x.b)").alias("fp"), "copies")
    return small.unionByName(huge)


def _differing(scratch: Scratch, marked: DataFrame) -> DataFrame:
    """Members whose text isn't that of their group's first text, found chunk by chunk."""
    on = ["fp", "n_bytes", "grp", "idx"]
    first = scratch.table(marked.where("is_first").select(*on, F.col("chunk").alias("first_chunk")).dropDuplicates(on), "first")
    compared = marked.where("not is_first").join(first, on)
    return scratch.table(compared.where(F.col("chunk") != F.col("first_chunk")).select("doc_id_", "sha256").distinct(), "odd")


def _with_first(rows: DataFrame) -> DataFrame:
    """Adds to rows with ``fp, n_bytes, grp`` whether they are their group's first; groups of one row go."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("sha256").alias("s"))
    return rows.join(rows.groupBy("fp", "n_bytes", "grp").agg(F.min(order).alias("first"), F.count("*").alias("rows")).where("rows > 1"), ["fp", "n_bytes", "grp"]).select(
        *rows.columns, (order == F.col("first")).alias("is_first")
    )


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", moduli=MODULI, bases=BASES) -> DataFrame:
    """A row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    kind = docs.schema[key].dataType.simpleString()
    none = "~"  # an id that is null gets a text key of its own, so that joins see it
    prints = scratch.table(fingerprints(docs, key, text, moduli, bases).withColumn("grp", F.lit(0)).withColumn("doc_id_", F.coalesce(F.col("doc_id").cast("string"), F.lit(none))), "prints")
    many = scratch.table(prints.groupBy("fp", "n_bytes").agg(F.count("*").alias("rows")).where("rows > 1").select("fp", "n_bytes"), "many")
    members = scratch.table(_with_first(prints.join(many, ["fp", "n_bytes"])).select("doc_id", "doc_id_", "sha256", "fp", "n_bytes", "grp", "is_first"), "members")
    wanted = members.select(F.col("doc_id_").alias("wanted"), "sha256", "n_bytes", "fp", "grp", "is_first")
    texts = docs.select(F.coalesce(F.col(key).cast("string"), F.lit(none)).alias("doc_id_"), F.col(text).alias("text"))
    texts = split_by_ids(texts, "doc_id_", wanted, "wanted")[1]
    texts = texts.join(wanted.hint("merge"), F.col("doc_id_") == F.col("wanted")).withColumn("norm", normalised(F.col("text")).cast("binary"))
    texts = texts.where((F.length("norm") == F.col("n_bytes")) & (F.sha2("norm", 256) == F.col("sha256")))
    chunks = scratch.table(texts.select("doc_id_", "sha256", "fp", "n_bytes", "grp", "is_first", F.posexplode(_chunks("norm")).alias("idx", "chunk")), "chunks")
    odd = _differing(scratch, chunks)
    moved = []
    while odd.head(1):  # fingerprints collided: what differs from the first text is a group of its own
        moved.append(odd.withColumn("grp", F.lit(len(moved) + 1)))
        members = scratch.table(_with_first(members.join(odd, ["doc_id_", "sha256"], "left_semi").drop("is_first").withColumn("grp", F.col("grp") + 1)), "members")
        odd = _differing(scratch, chunks.drop("grp", "is_first").join(members.select("doc_id_", "sha256", "grp", "is_first"), ["doc_id_", "sha256"]))
    scratch.drop(chunks)
    if moved:
        last = moved[0]
        for m in moved[1:]:
            last = last.unionByName(m)
        last = last.groupBy("doc_id_", "sha256").agg(F.max("grp").alias("new"))
        prints = prints.join(last, ["doc_id_", "sha256"], "left").withColumn("grp", F.coalesce("new", "grp")).drop("new")
    groups = prints.groupBy("fp", "n_bytes", "grp").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    joined = prints.join(groups, ["fp", "n_bytes", "grp"])
    # a group of null ids only keeps the first of its rows
    rows = joined.select("doc_id", "keep_id", "group_size", "sha256", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return rows.select(
        F.col("doc_id").cast(kind), F.col("keep_id").cast(kind), "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("sha256").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    groups = exact_groups(docs, key, text)
    verdict = groups.groupBy(F.col("doc_id").alias("id_"), F.col("text_sha256").alias("sha_")).agg(F.max("kept").alias("kept_"), F.count("*").alias("copies_"))
    out = Scratch(docs.sparkSession, "exact-verdict").table(verdict.where("not kept_ or copies_ > 1"), "verdict")
    surely, maybe = split_by_ids(docs, key, out, "id_")
    same = maybe[key].eqNullSafe(out["id_"]) & (F.sha2(normalised(maybe[text]).cast("binary"), 256) == out["sha_"])
    stay = maybe.join(out.hint("merge"), same, "left_anti")
    # rows of one id and text: one stays; an id may have several such texts, and null ids are many documents
    repeated = maybe.join(out.where("kept_").hint("merge"), same, "left_semi")
    sha = fresh("sha", docs)
    repeated = repeated.withColumn(sha, F.sha2(normalised(repeated[text]).cast("binary"), 256)).dropDuplicates([key, sha]).drop(sha)
    return surely.unionByName(stay).unionByName(repeated)


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
