"""Language identification by language-bitmask n-gram filters.

Each language's frequent character n-grams go into one Bloom filter that is bit-sliced: a slot holds
a mask with a bit for each language, and the masks of an n-gram's slots, and-ed, are all languages
that contain it. A text's language is the one with the most n-grams after each language's count is
corrected for the filter's false positives.

An n-gram is frequent in a language if it makes up at least ``MIN_SHARE`` of the n-grams of the
language's training texts, all of which are counted; so a language has at most 1/MIN_SHARE of each
order, whatever the size of the corpus, and the filter is a table of fixed size.

Defined results: null texts and texts without a letter are ``und`` with score 0; a text none of
whose n-grams is known gets the most frequent training language with score 0; ties go to the
language that comes first in order; without training texts everything is ``und``; rows of null
language aren't trained on; a null id is trained on only where the caller's fold says so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseg.llm.base import crc32_of, in_arrow, mix

ORDERS = (3, 4)
MIN_SHARE = 3e-5
MIN_COUNT = 2
SLOT_BITS = 20
HASHES = 3
UNKNOWN = "und"

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points with each run of other characters as one space, and which are letters."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _LETTER[codes]
    keep = np.ones(len(codes), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    codes = np.where(is_letter, codes, np.uint32(32))[keep]
    return codes.astype(np.uint64), is_letter[keep]


def ngrams(text: str, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Hashes of the n-grams within words; a word's borders count as a character."""
    codes, is_letter = letters(text)
    found = []
    with np.errstate(over="ignore"):
        for n in orders:
            m = len(codes) - n + 1
            if m <= 0:
                continue
            h, inside = np.full(m, n, np.uint64), np.ones(m, bool)
            for i in range(n):
                h = h * _STEP + codes[i : i + m]
                if 0 < i < n - 1:
                    inside &= is_letter[i : i + m]
            found.append(h[inside])
    return mix(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _count(orders):
    """Partial counts of each language's n-grams."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                by_lang: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    by_lang.setdefault(lang, []).append(ngrams(text, orders))
                for lang, grams in by_lang.items():
                    gram, n = np.unique(np.concatenate(grams), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(gram), pa.string()), "gram": pa.array(gram.view(np.int64), pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def slots(grams: np.ndarray, bits: int = SLOT_BITS, hashes: int = HASHES) -> list[np.ndarray]:
    a, b = grams & np.uint64(0xFFFFFFFF), (grams >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return [((a + b * np.uint64(i)) & np.uint64((1 << bits) - 1)).astype(np.int64) for i in range(hashes)]


class Filter:
    """The bit-sliced filter: ``words[slot, l // 64]`` has bit ``l % 64`` of language ``l``."""

    def __init__(self, langs: list[str], default: str | None, grams: np.ndarray, owner: np.ndarray, bits: int = SLOT_BITS, hashes: int = HASHES):
        self.langs, self.default, self.bits, self.hashes = langs, default, bits, hashes
        self.words = np.zeros((1 << bits, max(1, -(-len(langs) // 64))), np.uint64)
        for at in slots(grams, bits, hashes):
            np.bitwise_or.at(self.words, (at, owner // 64), np.uint64(1) << (owner % 64).astype(np.uint64))
        fill = np.array([((self.words[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(langs))])
        self.false = fill**hashes

    def masks(self, grams: np.ndarray) -> np.ndarray:
        at = slots(grams, self.bits, self.hashes)
        out = self.words[at[0]]
        for x in at[1:]:
            out &= self.words[x]
        return out

    def predict(self, text: str | None, orders=ORDERS) -> tuple[str, float]:
        if not text or not self.langs:
            return UNKNOWN, 0.0
        if not letters(text)[1].any():
            return UNKNOWN, 0.0
        grams = ngrams(text, orders)
        counts = np.zeros(len(self.langs))
        for i in range(0, len(grams), 1 << 16):
            masks = self.masks(grams[i : i + (1 << 16)])
            counts += [((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).sum() for k in range(len(self.langs))]
        counts = np.maximum(0, (counts - len(grams) * self.false) / (1 - self.false))
        if counts.sum() <= 0:
            return self.default, 0.0
        best = int(counts.argmax())
        return self.langs[best], float(counts[best] / counts.sum())


def learn(training: DataFrame, orders=ORDERS, min_share: float = MIN_SHARE, min_count: int = MIN_COUNT) -> Filter:
    """A filter from all rows of ``training(lang, text)``."""
    rows = training.where("lang is not null and text is not null").select("lang", "text")
    counted = rows.transform(in_arrow, _count(orders), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = counted.persist()
    try:
        totals = {r.lang: r.total for r in counted.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
        least = F.lit(None)
        for lang, total in totals.items():
            least = F.when(F.col("lang") == lang, F.lit(max(float(min_count), min_share * total))).otherwise(least)
        kept = counted.where(F.col("n") >= least).select("lang", "gram").toArrow() if totals else None
    finally:
        counted.unpersist()
    langs = sorted(totals)
    if not langs:
        return Filter([], None, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    number = {x: i for i, x in enumerate(langs)}
    owner = np.array([number[x] for x in kept.column("lang").to_pylist()], dtype=np.int64)
    grams = kept.column("gram").to_numpy().astype(np.int64).view(np.uint64)
    return Filter(langs, max(langs, key=lambda x: totals[x]), grams, owner)


def _predict(model, orders):
    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                found = [model.value.predict(t, orders) for t in part.column("text").to_pylist()]
                rest = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], [*rest, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Filter, orders=ORDERS) -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``lang_pred`` and ``score``."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.transform(in_arrow, _predict(shared, orders), f"{kinds}, lang_pred string, score double")


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(crc32_of(key) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per document, learned from those not held out."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), held_out(key).alias("held_out"))
    model = learn(rows.where(~F.col("held_out")))
    return predict(rows.select("doc_id", "held_out", "text"), model)
