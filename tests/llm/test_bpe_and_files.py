import hashlib
import os
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from sparkseg.llm import bpe, token_files

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string, k long, copies string"


def rows():
    words = "Hello wörld, it's  the\n\n end... 123 don't we'll ñandú 日本語 😀 ".split(" ")
    rng = np.random.default_rng(1)
    long = " ".join(words[i] for i in rng.integers(0, len(words), 900))
    return [(1, None), (2, ""), (3, "a"), (4, "x" * 3000), (5, " " * 3000 + "y"), (6, long), (6, long), (None, "null id"), (7, "<|endoftext|> we'll  \t\r\n"), (8, "'r" * 700), (9, long + "z" * 900 + long), (None, None)]


def df(spark, data=None):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in (rows() if data is None else data)], SCHEMA)


@pytest.mark.parametrize("chunk,overlap", [(100, 20), (257, 64), (32768, 512)])
def test_chunked_ids_are_those_of_the_whole_text(spark, chunk, overlap):
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    got = bpe.encode(df(spark), RANKS, P.PATTERN, chunk_chars=chunk, overlap=overlap).collect()
    want = [(i, enc.encode_ordinary(t or "")) for i, t in rows()]
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=repr) == sorted(want, key=repr)


def test_decoding_is_a_round_trip(spark):
    got = bpe.decode(bpe.encode(df(spark), RANKS, P.PATTERN, chunk_chars=200, overlap=40), RANKS).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in got) == sorted((str(i), (t or "").encode()) for i, t in rows())


def test_digests(spark):
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    for r in bpe.digests(df(spark, rows()[:4]), RANKS, P.PATTERN).collect():
        text = dict(rows()[:4])[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.digests(df(spark, []), RANKS, P.PATTERN).count() == 0


def test_token_files_hold_every_id_in_order(spark, tmp_path):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    data = [*rows(), (10, "Straße ΟΔΟΣ ΟΔΟΣ. İstanbul éa ́x a\x1c,b Ünï.,!? it's 'TWAS don'T A.B, x.y.  z"), (11, "The the, the. THE")]
    manifest = token_files.write_tokens(df(spark, data), str(tmp_path), P.path("word_bpe_49k.json"), partitions=3)
    got = sorted(token_files.read_tokens(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    start = 0
    for (i, text), r in zip(sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")), got, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(ids)), (i, text)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()), (i, text)
        start += len(ids)
    assert manifest["n_tokens"] == start


def test_token_files_of_an_empty_table(spark, tmp_path):
    assert token_files.write_tokens(df(spark, []), str(tmp_path), P.path("word_bpe_49k.json"))["n_tokens"] == 0
    assert token_files.read_tokens(spark, str(tmp_path)).count() == 0


def test_words_are_forgotten_when_there_are_too_many(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_WORDS", 3)
    t = token_files.WordTokenizer(P.path("word_bpe_49k.json"), "<u2")
    once = t(["a b c d e f, g."])
    assert t(["z y x", "a b c d e f, g."])[1] == once[0]


def test_words_get_the_ids_of_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    own = token_files.WordTokenizer(P.path("word_bpe_49k.json"), "<u2")
    letters = [chr(i) for i in range(1, 0x500) if not chr(i).isspace()]
    rng = np.random.default_rng(0)
    words = letters + [c + "ab" for c in letters] + ["Ab" + c for c in letters] + ["".join(rng.choice(letters, 5)) for _ in range(3000)]
    words += ["<|endoftext|>", "a<|startoftext|>b.", "x.)", "it's", "A!", "\u0130x", "\u03a3\u03a3", "e\u0301a", "\u212aa", "\ufb01x"]
    for text in [*words, " ".join(words)]:
        assert np.frombuffer(own([text])[0], "<u2").tolist() == t.encode(text, add_special_tokens=False).ids, text
