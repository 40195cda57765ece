"""The five stages against plain Python, each over what the stage before it kept."""

import hashlib
import random

import corpus_pipeline
import public_tokenizers as P
import tiktoken

from sparkseg.llm import bpe, quality
from sparkseg.llm.base import words_of
from test_dedup import brute_near, norm


def shingles(text):
    w = words_of(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def corpus():
    rng = random.Random(21)
    vocabulary = [f"{a}{b}{c}" for a in ("ri", "sto", "qui", "mor") for b in ("ver", "ne", "et", "ning") for c in ("", "s", "ly", "al")]
    some = lambda k: " ".join(rng.choices(vocabulary, k=k))
    items = [(i, some(25)) for i in range(4)]
    good = [some(rng.randint(20, 90)) + "." for _ in range(90)]
    good += [good[0], good[0].replace(" ", "\n "), good[1] + " and more", items[0][1], some(40) + " " + items[1][1] + " " + some(30), good[2] + " " + some(2)]
    bad = [" | ".join(w.upper() + "!!" for w in some(rng.randint(10, 40)).split()) for _ in range(40)]
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good + bad)]
    docs += [docs[5], docs[5], (7, "another text of id seven " + some(30), "en", "s", 1), (None, some(30), None, None, None), (None, some(30), None, None, None), (900, None, "en", "s", None), (901, "", "en", "s", 0), (902, " \t", "en", "s", 2)]
    labels = [(i, int(i < len(good)), 0) for i in range(len(good) + len(bad)) if i % 7]
    return docs, items, labels


def test_stages_against_brute_force(spark, tmp_path):
    docs, items, labels = corpus()
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", items, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    (_, filtered), (_, exact), (_, near), (_, clean), (_, encode) = corpus_pipeline.STAGES
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    one = filtered(spark, at, str(tmp_path))
    assert one.columns == at.columns
    judged = quality.judge(at, spark.read.parquet(f"{tmp_path}/labels.parquet")).where("predicted = 1")
    kept = pairs(one)
    assert sorted(repr(r.doc_id) for r in judged.collect()) == sorted(repr(i) for i, _ in kept)
    assert {i for i, _ in kept if i is not None and i < 96} >= set(range(90)) and not {i for i, _ in kept} & set(range(96, 136))

    two = exact(spark, one, str(tmp_path))
    groups = {}
    for i, t in kept:
        groups.setdefault(norm(t), []).append((i is None, i, t))
    left = sorted(((min(g, key=lambda x: (x[0], x[1] or 0))[1], t) for t, g in groups.items()), key=repr)
    assert sorted(((i, norm(t)) for i, t in pairs(two)), key=repr) == left and two.columns == at.columns

    rows = pairs(two)
    three = near(spark, two, str(tmp_path))
    stays = {i for i, _, c, k in brute_near(rows) if k or i == c}
    assert pairs(three) == [x for x in rows if x[0] in stays] and three.columns == at.columns

    rows = pairs(three)
    four = clean(spark, three, str(tmp_path))
    dirty = {i for i, t in rows for _, b in items if 100 * len(shingles(b) & shingles(t)) >= 75 * len(shingles(b))}
    assert dirty and pairs(four) == [x for x in rows if x[0] not in dirty]

    rows = pairs(four)
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, encode(spark, four, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)
