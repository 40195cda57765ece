"""Token ids in flat files of unsigned integers with 64-bit offsets, read by memory mapping.

Rows are dealt by ranges of the id, so that partitions and the rows in them ascend. Each task
writes three files of its own name (tokens, offsets relative to the part, document ids) and returns
their counts; only files of tasks that succeeded enter the manifest, so a task that runs twice does
no harm. Prefix sums over the parts' counts give each part's base.

Format: ``tokens-*.bin`` little-endian uint16 (vocabulary up to 65,536) or uint32;
``offsets-*.bin`` int64, one more than documents; ``ids-*.bin`` int64; ``manifest.json``.

Defined results: strings of special tokens in a text get their ids, as the library gives them; null text holds the end id alone; a null id stands first and reads back as null;
rows with one id stand in order of their text; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import itertools
import json
import os
import re
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseg.llm.base import in_arrow

CACHED_WORDS = 500_000
WORDS_AT_ONCE = 500
END_ID = 1
NULL_ID = -(2**63)


#: Letters whose lower case is one letter whatever stands around them and that no normal form changes.
_SIMPLE = "".join(chr(i) for i in range(0x250) if chr(i).isalpha() and i != 0x130)
#: Such letters, and at most one mark after them, which is a token of its own.
_SIMPLE_WORD = re.compile(f"([{_SIMPLE}]+)([.,;:!?)]?)")


class WordTokenizer:
    """Ids of a text by the tokenizers library, word by word.

    The tokenizer's pattern never joins characters across a space or line feed, its normal form
    neither, so a text's ids are those of its words one after another; words are remembered. A word of
    simple letters is one match of the pattern, so a new one goes, in lower case, to a copy of the tokenizer
    without normal form and pattern; all other new words go through the whole tokenizer.
    """

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.tokenizer = Tokenizer.from_str(json.dumps(parts))
        spaces = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
        to_bytes = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        parts |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [spaces, to_bytes]}}
        self.bare = Tokenizer.from_str(json.dumps(parts))
        suffix, vocabulary = parts["model"]["end_of_word_suffix"], self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.dtype = dtype
        self.known: dict[str, bytes] = {}
        self.marks = dict(zip(".,;:!?)", self._ids(self.tokenizer, list(".,;:!?)")))) | {"": b""}

    def _ids(self, tokenizer, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)] if words else []

    def _simple_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words of simple letters, many at a time: the last token of each word says that it is the last."""
        texts = [" ".join(words[i : i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)]
        found = [e.ids for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)] if words else []
        ids = np.fromiter(itertools.chain.from_iterable(found), np.int64)
        packed, width = ids.astype(self.dtype).tobytes(), np.dtype(self.dtype).itemsize
        ends = [0, *((np.flatnonzero(self.is_end[ids]) + 1) * width).tolist()]
        return [packed[x:y] for x, y in zip(ends, ends[1:])]

    @staticmethod
    def words(text: str) -> list[str]:
        return text.replace("\n", " ").split(" ")

    def _learn(self, words: set[str]) -> None:
        known, marks = self.known, self.marks
        known[""] = b""
        words.discard("")
        bases, rest = {}, []
        for w in words:
            base = w if w.isalpha() else w[:-1]
            if base.isascii() and base.isalpha() and (base is w or w[-1] in marks):  # most words; the pattern is slower
                bases[w] = base.lower()
            elif m := _SIMPLE_WORD.fullmatch(w):
                bases[w] = m[1].lower()
            else:
                rest.append(w)
        new = list(set(bases.values()).difference(known))
        known.update(zip(new, self._simple_ids(new), strict=True))
        for w, base in bases.items():
            known[w] = known[base] if len(w) == len(base) else known[base] + marks[w[-1]]
        known.update(zip(rest, self._ids(self.tokenizer, rest)))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, packed."""
        collecting = gc.isenabled()
        gc.disable()  # nothing here refers to itself, and the words remembered would be looked at each time
        try:
            return self._packed(texts)
        finally:
            if collecting:
                gc.enable()

    def _packed(self, texts: list[str | None]) -> list[bytes]:
        split = [self.words(text) if text else [] for text in texts]
        seen = set().union(*split)
        if missing := seen.difference(self.known):
            if len(self.known) + len(missing) > CACHED_WORDS:  # the words at hand stay
                self.known = {w: self.known[w] for w in seen.difference(missing)}
            self._learn(missing)
        ids_of = self.known.__getitem__
        return [b"".join(map(ids_of, words)) for words in split]


_tokenizers: dict[tuple[str, str], WordTokenizer] = {}


def tokenizer_of(path: str, dtype: str) -> WordTokenizer:
    """One for each process, so that later tasks know the words of earlier ones."""
    if (path, dtype) not in _tokenizers:
        _tokenizers[path, dtype] = WordTokenizer(path, dtype)
    return _tokenizers[path, dtype]


def _file_system(uri: str):
    if "://" in uri or uri.startswith("file:"):
        return pa.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    return pa.fs.LocalFileSystem(), uri


def _writer(folder: str, path: str, dtype: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        fs, base = _file_system(folder)
        fs.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"
        encode, end = tokenizer_of(path, dtype), np.array([end_id], dtype=dtype).tobytes()
        width, docs, tokens = np.dtype(dtype).itemsize, 0, 0
        with fs.open_output_stream(f"{base}/tokens-{name}.bin") as t, fs.open_output_stream(f"{base}/offsets-{name}.bin") as o, fs.open_output_stream(f"{base}/ids-{name}.bin") as i:
            o.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                for rows in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                    found = [x + end for x in encode(rows.column("text").to_pylist())]
                    offsets = tokens + np.cumsum([len(x) // width for x in found])
                    t.write(b"".join(found))
                    o.write(offsets.astype("<i8").tobytes())
                    i.write(rows.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    docs, tokens = docs + rows.num_rows, int(offsets[-1])
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "n_docs": pa.array([docs], pa.int64()), "n_tokens": pa.array([tokens], pa.int64())})

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", vocabulary: int = 49_408, end_id: int = END_ID, partitions: int | None = None) -> dict:
    """Write the files and the manifest; returns the manifest (a few numbers for each partition)."""
    spark = docs.sparkSession
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    parts = dealt.transform(in_arrow, _writer(folder, tokenizer, dtype, end_id), "part int, name string, n_docs long, n_tokens long").collect()
    parts = sorted((p.asDict() for p in parts), key=lambda p: p["part"])
    base_docs = base_tokens = 0
    for p in parts:
        p |= {"base_docs": base_docs, "base_tokens": base_tokens}
        base_docs, base_tokens = base_docs + p["n_docs"], base_tokens + p["n_tokens"]
    manifest = {"dtype": dtype, "end_id": end_id, "n_docs": base_docs, "n_tokens": base_tokens, "parts": parts}
    fs, base = _file_system(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def mapped(folder: str, name: str, dtype: str) -> np.ndarray:
    """A file as a memory map; one in a remote store is first copied to a local temporary file."""
    fs, base = _file_system(folder)
    if fs.get_file_info(f"{base}/{name}").size == 0:
        return np.zeros(0, dtype)
    if isinstance(fs, pa.fs.LocalFileSystem):
        return np.memmap(f"{base}/{name}", dtype=dtype, mode="r")
    with tempfile.NamedTemporaryFile() as f:
        with fs.open_input_stream(f"{base}/{name}") as source:
            while block := source.read(1 << 24):
                f.write(block)
        f.flush()
        return np.memmap(f.name, dtype=dtype, mode="r")  # the map keeps the file's blocks until it goes


def _reader(folder: str, dtype: str):
    def run(batches):
        for batch in batches:
            for p in batch.to_pylist():
                if not p["n_docs"]:
                    continue
                tokens, at, ids = (mapped(folder, f"{kind}-{p['name']}.bin", d) for kind, d in (("tokens", dtype), ("offsets", "<i8"), ("ids", "<i8")))
                for i in range(0, p["n_docs"], 2000):
                    a = np.array(at[i : i + 2001])
                    crc = [zlib.crc32(tokens[x:y].astype("<u4").tobytes()) for x, y in zip(a[:-1], a[1:])]
                    d = np.array(ids[i : i + len(crc)])
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(d, pa.int64(), mask=d == NULL_ID), "start": pa.array(a[:-1] + p["base_tokens"], pa.int64()), "n_tokens": pa.array(np.diff(a), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return run


def read_manifest(folder: str) -> dict:
    fs, base = _file_system(folder)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        return json.loads(f.read())


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Per document from the files: ``doc_id, start, n_tokens, ids_crc32``; a task for each part."""
    manifest = read_manifest(folder)
    schema = "part int, name string, n_docs long, n_tokens long, base_docs long, base_tokens long"
    parts = spark.createDataFrame([tuple(p[c.split()[0]] for c in schema.split(", ")) for p in manifest["parts"]], schema)
    return parts.repartition(max(1, len(manifest["parts"]))).transform(in_arrow, _reader(folder, manifest["dtype"]), "doc_id long, start long, n_tokens long, ids_crc32 long")
