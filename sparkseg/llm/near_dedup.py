"""MinHash near-deduplication with tensored banding.

Two small collections of sketches are computed, each sketch a pair of min-hashes; a table's key
combines one sketch of the first collection with one of the second. 16 + 16 sketches so serve 256
tables of four min-hashes each, for 64 min-hashes where independent tables would need 1,024.

Texts with the same shingle set are one class from the start. In the buckets of 16 of the tables,
one for each sketch, members are compared with a centre, links confirmed on the full sets, and
components formed. What is then still in different components is searched in all tables: two classes
share a table if they share a first and a second sketch, so buckets of first sketches that several
components share are joined with themselves where a second sketch is equal too, without a row for
each table. A pair within the bucket's largest component isn't formed. A pair of similarity 0.75
misses every table with a probability of 4e-6.

Pairs are formed only if they pass two comparisons of sketches inside the join: parities of the
shingles' hashes in 1,024 slots (a set difference of d changes at most d of them, so no pair at the
threshold fails) and two bits of 256 min-hashes, of which a pair at the threshold fails with a
probability of 1e-6. What passes is confirmed on the full sets. So neither pairs nor sets are formed
for a group's unrelated members; what grows with the square of a bucket's components is the
comparison of sketches inside the join.

Defined results: null and empty texts and those without words have no shingles, no links and are
kept; null ids count as larger than any other (a component of null ids alone has a null id);
repeated rows give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseg.llm.base import SHINGLE_WORDS, SIMILARITY_PERCENT, Scratch, in_arrow, mix, shingle_sets, split_by_ids, without_ids
from sparkseg.llm.components import components

SKETCHES = 16
PAIR = 2
VALUES = 256  # min-hashes; the first 64 make the sketches, two bits of each are compared before the exact check
#: A pair of similarity 0.75 differs in 48 of them on average, with a deviation of 6.2.
MOST_DIFFERENT = 78
CENTRE_ROUNDS = 2

_SEEDS = mix(np.arange(1, VALUES + 1, dtype=np.uint64))
_ODD = (_SEEDS >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = _SEEDS.astype(np.uint32)
#: Columns of packed integers: both collections, two sketches in each, and the two-bit values.
FIRST = [f"p{i}" for i in range(SKETCHES // 2)]
SECOND = [f"q{i}" for i in range(SKETCHES // 2)]
BITS = [f"b{i}" for i in range(VALUES // 32)]
#: Parities of the number of shingles in each slot.
SLOTS = 1024
ODD = [f"o{i}" for i in range(SLOTS // 64)]
SIGNS = [*FIRST, *SECOND, *BITS, *ODD]


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    best, high = np.full(VALUES, 0xFFFFFFFF, dtype=np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(high), 1024):
        hashed = high[i : i + 1024, None] * _ODD
        hashed += _ADD
        np.minimum(best, hashed.min(axis=0), out=best)
    return best


def signature(shingles: np.ndarray) -> np.ndarray:
    """``SIGNS`` of a set."""
    hashes = min_hashes(shingles)
    pairs = hashes[: 2 * SKETCHES * PAIR].astype(np.uint64).reshape(2 * SKETCHES, PAIR)
    keys = mix(pairs[:, 0] << np.uint64(32) | pairs[:, 1]) >> np.uint64(32)
    two = ((hashes * np.uint32(0x9E3779B1)) >> np.uint32(30)).astype(np.uint64).reshape(-1, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))
    odd = np.packbits(np.bincount((shingles & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS) & 1, bitorder="little").view(np.uint64)
    return np.concatenate([keys[::2] | keys[1::2] << np.uint64(32), np.bitwise_or.reduce(two, axis=1), odd]).view(np.int64)


def class_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signatures(width: int):
    names = SIGNS

    def run(batches):
        none = np.zeros(len(names), np.int64)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                cids, sizes, found = [], [], []
                for s in shingle_sets(part.column("text").to_pylist(), width):
                    cids.append(class_key(s) if len(s) else None)
                    sizes.append(len(s))
                    found.append(signature(s) if len(s) else none)
                table = np.array(found, dtype=np.int64).reshape(-1, len(names))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(cids, pa.binary()), pa.array(sizes, pa.int64()), *(pa.array(np.ascontiguousarray(table[:, i])) for i in range(len(names)))], ["doc_id", "cid", "n", *names])

    return run


def _sets(width: int):
    """The shingle set of the texts whose class is the one asked for."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                numbers, sets = [], []
                for number, cid, s in zip(part.column("k").to_pylist(), part.column("cid").to_pylist(), shingle_sets(part.column("text").to_pylist(), width)):
                    if len(s) and class_key(s) == cid:
                        numbers.append(number)
                        sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(sets, pa.binary())], ["k", "shingles"])

    return run


def _confirm(percent: int):
    """Pairs of sets whose similarity reaches ``percent``."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _different(one: str, other: str) -> Column:
    """How many of the two-bit values differ."""
    parts = [f"bit_count((({one}.{b} ^ {other}.{b}) | shiftrightunsigned({one}.{b} ^ {other}.{b}, 1)) & 6148914691236517205L)" for b in BITS]
    return F.expr(" + ".join(parts))


def _lanes(packed: list[str], table: str = "") -> list[str]:
    """The single sketches of packed columns."""
    dot = f"{table}." if table else ""
    return [x for p in packed for x in (f"({dot}{p} & 4294967295L)", f"shiftrightunsigned({dot}{p}, 32)")]


def _share_second(one: str, other: str) -> Column:
    """Whether two classes have an equal second sketch."""
    return F.expr(" or ".join(f"{x} = {y}" for x, y in zip(_lanes(SECOND, one), _lanes(SECOND, other))))


def _likely(one: str, other: str, percent: int) -> Column:
    """What pairs of this similarity fulfil: certainly in size and parities, nearly surely in two-bit values."""
    size = F.expr(f"100 * least({one}.n, {other}.n) >= {percent} * greatest({one}.n, {other}.n)")
    odd = F.expr(f"{100 + percent} * (" + " + ".join(f"bit_count({one}.{o} ^ {other}.{o})" for o in ODD) + f") <= {100 - percent} * ({one}.n + {other}.n)")
    return size & odd & (_different(one, other) <= MOST_DIFFERENT)


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """A row per document: ``doc_id, n_shingles, component_id, kept``."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    longs = ", ".join(f"{x} long" for x in SIGNS)
    signed = scratch.table(rows.transform(in_arrow, _signatures(width), f"doc_id {kind}, cid binary, n long, {longs}"), "signed")
    classes = signed.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("rep"), *(F.max(x).alias(x) for x in ("n", *SIGNS)))
    classes = scratch.table(classes.withColumn("k", F.monotonically_increasing_id()), "classes")  # written, so numbers stay

    def sets_of(involved: DataFrame) -> DataFrame:
        """The shingle sets of classes, each from one of its documents."""
        wanted = involved.select("k", "cid", F.coalesce(F.col("rep").cast("string"), F.lit("~")).alias("id"))
        texts = split_by_ids(rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")).alias("id"), "text"), "id", wanted, "id")[1]
        texts = texts.join(wanted.hint("merge"), "id").select("k", "cid", "text")
        return scratch.table(texts.transform(in_arrow, _sets(width), "k long, shingles binary").dropDuplicates(["k"]), "sets")

    def rooted(of: DataFrame, roots: DataFrame | None) -> DataFrame:
        """Rows of classes with the root of their component so far."""
        if roots is None:
            return of.withColumn("root", F.col("k"))
        return of.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))

    def with_centres(members: DataFrame, involved: DataFrame, turn: int) -> DataFrame:
        """Likely pairs of a bucket's members with its centre, a member of its largest component."""
        sizes = members.groupBy("tab", "root").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("k", "tab", F.lit(turn)).alias("h"), "k")).alias("first"))
        tabs = sizes.groupBy("tab").agg(F.count("*").alias("roots"), F.max(F.struct("c", "root", "first")).alias("top")).where("roots > 1")
        open_tabs = tabs.select("tab", F.col("top.first.k").alias("centre"), F.col("top.root").alias("centre_root"))
        pairs = members.join(open_tabs, "tab").where("root <> centre_root").select(F.least("k", "centre").alias("a"), F.greatest("k", "centre").alias("b")).distinct()
        signs = involved.select("k", "n", *BITS, *ODD)
        l, r = pairs.join(signs.withColumnRenamed("k", "a"), "a").alias("l"), signs.alias("r")
        return l.join(r, (F.col("l.b") == F.col("r.k")) & _likely("l", "r", percent)).select("a", "b")

    def linked(found: DataFrame, sets: DataFrame, roots: DataFrame | None) -> DataFrame:
        """Roots after the pairs ``a, b`` that reach the similarity on their full sets."""
        with_x = found.join(sets.select(F.col("k").alias("a"), F.col("shingles").alias("x")), "a")
        with_y = with_x.join(sets.select(F.col("k").alias("b"), F.col("shingles").alias("y")), "b")
        new = scratch.table(with_y.select("a", "b", "x", "y").transform(in_arrow, _confirm(percent), "a long, b long"), "new")
        return components(new if roots is None else new.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), scratch)

    # one table for each sketch settles most links with few rows
    tab = F.array(*(F.xxhash64(F.lit(i), F.expr(x), F.expr(y)) for i, (x, y) in enumerate(zip(_lanes(FIRST), _lanes(SECOND)))))
    some = classes.select("k", F.explode(tab).alias("tab"))
    full = some.groupBy("tab").agg(F.count("*").alias("members")).where("members > 1").select("tab")
    buckets = scratch.table(some.join(full, "tab"), "some")
    involved = scratch.table(classes.join(buckets.select("k").distinct(), "k"), "involved")
    sets, roots = sets_of(involved), None
    for turn in range(CENTRE_ROUNDS):
        members = scratch.table(rooted(buckets, roots), "members")
        roots = linked(with_centres(members, involved, turn), sets, roots)
        scratch.drop(members)
    scratch.drop(buckets, involved, sets)

    # all tables: buckets of first sketches that several components share, joined where a second sketch is equal
    each = F.posexplode(F.array(*(F.expr(x) for x in _lanes(FIRST)))).alias("i", "u")
    first = rooted(classes.select("k", *FIRST), roots).select("k", "root", each)
    sizes = first.groupBy("i", "u", "root").agg(F.count("*").alias("c"))
    tabs = sizes.groupBy("i", "u").agg(F.count("*").alias("several"), F.max(F.struct("c", "root"))["root"].alias("largest")).where("several > 1").drop("several")
    wide = scratch.table(first.join(tabs, ["i", "u"]).join(classes.select("k", "n", *SECOND, *BITS, *ODD), "k"), "wide")
    l, r = wide.where("root <> largest").alias("l"), wide.alias("r")
    other = F.expr("l.root <> r.root and (r.root = r.largest or l.k < r.k)")
    both = l.join(r, (F.col("l.i") == F.col("r.i")) & (F.col("l.u") == F.col("r.u")) & other & _share_second("l", "r") & _likely("l", "r", percent))
    pairs = scratch.table(both.select(F.least("l.k", "r.k").alias("a"), F.greatest("l.k", "r.k").alias("b")).distinct(), "pairs")
    sets = sets_of(scratch.table(classes.join(pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct(), "k"), "involved"))
    roots = linked(pairs, sets, roots)
    scratch.drop(wide, pairs, sets)

    all_rooted = rooted(classes.select("k", "cid", "rep"), roots)
    least = all_rooted.groupBy("root").agg(F.min("rep").alias("component"))
    named = scratch.table(all_rooted.join(least, "root").select("cid", "component"), "named")
    out = signed.select("doc_id", "cid", "n").join(named, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all their columns.

    An id that several texts share stays if one of them does.
    """
    groups = near_groups(docs, key, text, **options)
    gone = groups.groupBy(F.col("doc_id").alias("id_")).agg(F.max("kept").alias("kept_")).where("not kept_").select("id_")
    gone = Scratch(docs.sparkSession, "near-gone").table(gone, "gone")
    return without_ids(docs, key, gone, "id_")


_SHINGLES = r"""
w AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
d AS (SELECT rid, doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w)
"""

ORACLE_SQL = f"""
WITH RECURSIVE {_SHINGLES.strip()},
s AS (SELECT rid, hash(g) AS h, len(sh) AS n FROM d, unnest(sh) AS t(g)),
p AS (SELECT x.rid AS a, y.rid AS b FROM s x JOIN s y ON x.h = y.h AND x.rid <> y.rid GROUP BY x.rid, y.rid, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
c(rid, root) AS (SELECT rid, doc_id FROM d UNION SELECT p.b, c.root FROM c JOIN p ON p.a = c.rid),
m AS (SELECT rid, min(root) AS component_id FROM c GROUP BY rid)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN m USING (rid)
"""
