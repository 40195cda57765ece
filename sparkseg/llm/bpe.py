"""Byte-level BPE: overlapping chunk encoding, and decoding by concatenation of bytes.

A long text is cut into chunks that overlap. Each chunk is pre-tokenised by itself, in parallel;
two neighbours are stitched at the first position in their overlap where both begin a pre-token,
since from there on both go on alike. The stitched pieces are encoded, in parallel again, and
their ids joined in order. Where an overlap has no common boundary (one run of letters fills it)
the whole text is encoded as one piece, so the ids are always those of the undivided text.

Defined results: null text encodes as empty (no ids), a null id stays null, repeated rows give a
row each, an empty table an empty result; null ids decode to no bytes.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseg.llm.base import in_arrow

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
#: A pre-token's end is certain this far from a cut: the pattern looks at most three characters on.
CERTAIN_CHARS = 4
CACHED_PIECES = 100_000
ROWS_AT_ONCE = 200


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Encoder:
    """Pre-tokens by the pattern, each merged by the ranks on its own; remembers a bounded number."""

    def __init__(self, path: str, pattern: str):
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
        self.split = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids of a text as packed 32-bit integers."""
        known, out = self.known, []
        for piece in self.split.findall(text):
            ids = known.get(piece)
            if ids is None:
                found = self.core._encode_single_piece(piece.encode("utf-8", "replace"))
                ids = struct.pack(f"={len(found)}i", *found)
                if len(piece) < 64:
                    if len(known) >= CACHED_PIECES:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def starts(self, text: str, zones: list[tuple[int, int]]) -> list[list[int]]:
        """Where pre-tokens begin, within each zone."""
        found = np.fromiter((m.start() for m in self.split.finditer(text)), dtype=np.int64)
        return [found[(found >= a) & (found < b)].tolist() for a, b in zones]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def _lists(rows: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.fromiter((i for r in rows for i in r), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _encode(path: str, pattern: str):
    """The last column, a text, becomes its ids."""

    def run(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            for part in (batch.slice(i, ROWS_AT_ONCE) for i in range(0, batch.num_rows, ROWS_AT_ONCE)):
                texts = part.columns[-1].to_pylist()
                packed = [enc.encode(t) if t else b"" for t in texts]
                offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], [*part.schema.names[:-1], "ids"])

    return run


def _cut(chunk_chars: int, overlap: int):
    """A row per chunk of the last column, a text: its number, whether it is the last, the text."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row, text = batch.slice(i, 1), batch.columns[-1][i].as_py()
                last = max(0, (len(text) - overlap - 1) // chunk_chars)
                for k in range(last + 1):
                    piece = text[k * chunk_chars : (k + 1) * chunk_chars + overlap if k < last else None]
                    yield pa.RecordBatch.from_arrays([*row.columns[:-1], pa.array([k], pa.int32()), pa.array([k == last]), pa.array([piece])], [*row.schema.names[:-1], "k", "is_last", "piece"])

    return run


def _zones(path: str, pattern: str, chunk_chars: int, overlap: int):
    """Adds the pre-token starts of the zones that a chunk shares with the one before and the one after."""

    def run(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            heads, tails = [], []
            for k, is_last, piece in zip(*(batch.column(c).to_pylist() for c in ("k", "is_last", "piece"))):
                head, tail = enc.starts(piece, [(0, overlap - CERTAIN_CHARS if k else 0), (len(piece) if is_last else chunk_chars, len(piece) - CERTAIN_CHARS)])
                heads.append(head)
                tails.append([p - chunk_chars for p in tail])
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(heads), _lists(tails)], [*batch.schema.names, "head", "tail"])

    return run


def _short_and_long(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[DataFrame, DataFrame]:
    """The texts of one chunk, ``doc_id, text``, and the ids of the longer ones, ``doc_id, ids``."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    is_long = F.length("text") > chunk_chars + overlap

    # equal rows share a key, so that it is the same whenever a task is run again
    long = rows.where(is_long).groupBy("doc_id", "text").agg(F.count("*").alias("copies")).select("doc_id", F.sha2("text", 256).alias("sha"), "copies", "text")
    keys = f"doc_id {kind}, sha string, copies long"
    cut = long.transform(in_arrow, _cut(chunk_chars, overlap), f"{keys}, k int, is_last boolean, piece string").repartition("doc_id", "sha", "k")
    zoned = cut.transform(in_arrow, _zones(path, pattern, chunk_chars, overlap), f"{keys}, k int, is_last boolean, piece string, head array<int>, tail array<int>")
    by_doc = "partition by doc_id, sha"
    stitched = zoned.selectExpr("*",
        f"case when k = 0 then 0 else array_min(array_intersect(lag(tail) over ({by_doc} order by k), head)) end as start",
        f"case when is_last then length(piece) else {chunk_chars} + array_min(array_intersect(tail, lead(head) over ({by_doc} order by k))) end as stop",
    ).selectExpr("*", f"min(start is not null and stop is not null) over ({by_doc}) as in_step")
    pieces = stitched.where("in_step").selectExpr("doc_id", "sha", "copies", "k", "substring(piece, start + 1, stop - start) as piece")
    # without a common boundary: each chunk's own part again, joined to the whole text
    whole = stitched.where("not in_step").selectExpr("doc_id", "sha", "copies", "k", f"if(is_last, piece, substring(piece, 1, {chunk_chars})) as piece")
    whole = whole.groupBy("doc_id", "sha", "copies").agg(F.expr("array_join(transform(array_sort(collect_list(struct(k, piece))), x -> x.piece), '')").alias("piece")).select("doc_id", "sha", "copies", F.lit(0).alias("k"), "piece")
    encoded = pieces.repartition("doc_id", "sha", "k").unionByName(whole).transform(in_arrow, _encode(path, pattern), f"{keys}, k int, ids array<int>")
    joined = encoded.groupBy("doc_id", "sha", "copies").agg(F.expr("flatten(transform(array_sort(collect_list(struct(k, ids))), x -> x.ids))").alias("ids"))
    return rows.where(~is_long), joined.select("doc_id", "ids", F.explode(F.expr("sequence(1, copies)")).alias("copy")).drop("copy")


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", **options) -> DataFrame:
    """``doc_id, ids array<int>``, a row per document."""
    short, long = _short_and_long(docs, path, pattern, key, **options)
    return short.transform(in_arrow, _encode(path, pattern), f"doc_id {docs.schema[key].dataType.simpleString()}, ids array<int>").unionByName(long)


def _decode(path: str):
    def run(batches):
        table: list[bytes] = []
        for token, rank in load_ranks(path).items():
            if rank >= len(table):
                table.extend([b""] * (rank + 1 - len(table)))
            table[rank] = token
        for batch in batches:
            for part in (batch.slice(i, ROWS_AT_ONCE) for i in range(0, batch.num_rows, ROWS_AT_ONCE)):
                ids = part.column("ids")
                flat, at = ids.flatten().to_numpy(zero_copy_only=False).tolist(), np.concatenate([[0], np.cumsum(np.nan_to_num(np.array([len(x) if x.is_valid else 0 for x in ids])))]).tolist()
                texts = [b"".join(map(table.__getitem__, flat[at[i] : at[i + 1]])) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*part.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the bytes of the tokens of ``ids`` one after another."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.transform(in_arrow, _decode(path), f"{kinds}, decoded binary")


def _round_trip(path: str, pattern: str):
    """Encodes and then decodes in one process, so that a task needs one worker and ids don't travel between two."""

    def run(batches):
        yield from _decode(path)(_encode(path, pattern)(batches))

    return run


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", **options) -> DataFrame:
    """``doc_id, ids, decoded``: ``decode`` of ``encode``."""
    short, long = _short_and_long(docs, path, pattern, key, **options)
    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, ids array<int>, decoded binary"
    return short.transform(in_arrow, _round_trip(path, pattern), schema).unionByName(decode(long, path))


def digests(docs: DataFrame, path: str, pattern: str, **names) -> DataFrame:
    """Per document the number of ids, and digests of the ids and of the decoded bytes."""
    return round_trip(docs, path, pattern, **names).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
