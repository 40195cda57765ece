import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseg.llm import components, decontam, exact_dedup, near_dedup, substring_dedup
from sparkseg.llm.base import Scratch, window_hashes, word_hashes, words_of

SCHEMA = "doc_id long, text string, kept string, component_id long, cid string, fp string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, "y", "z") for i, t in rows], SCHEMA)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def exact_rows():
    big = "word  soup\n" * 30_000
    return [(5, "a b"), (3, "a\t\n b"), (9, "a  b"), (1, None), (2, ""), (4, " "), (6, "x y"), (7, "x y"), (None, "a b"), (None, "only null"), (None, "only null"), (8, big), (10, big.replace("\n", " \n")), (11, big + "!"), (12, "dup"), (12, "dup"), (13, "dup"), (14, "q" * 16384), (15, "q" * 16385)]


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, done = (min(known) if known else None), False
        for i in ids:
            kept = i == keep and not done
            done |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("moduli", [exact_dedup.MODULI, (3, 2)])
def test_exact_groups(spark, moduli):
    """With moduli this small nearly all fingerprints of one length collide; the comparison must tell them apart."""
    rows = exact_rows() + [(100 + i, f"c{i % 7}") for i in range(20)]
    got = exact_dedup.exact_groups(frame(spark, rows), moduli=moduli, bases=tuple(b % m for b, m in zip(exact_dedup.BASES, moduli))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_exact(rows)))


def test_exact_deduplicated_keeps_columns(spark):
    rows = exact_rows()
    got = exact_dedup.deduplicated(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    assert sorted((str(r.doc_id), norm(r.text)) for r in got.collect()) == sorted((str(i), t) for (i, k, n, kept, h), t in zip(brute_exact(rows), [t for t, ids in _by_text(rows).items() for _ in ids]) if kept)
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
    assert exact_dedup.deduplicated(frame(spark, [])).count() == 0


def _by_text(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    return groups


def test_fingerprints_compose():
    poly, data = exact_dedup.Polynomial(), np.random.default_rng(0).integers(0, 256, 5000).astype(np.uint8)
    for cut in (1, 777, 4999):
        x, y, s = poly.chunk(data[:cut]), poly.chunk(data[cut:]), poly.shift(len(data) - cut)
        assert tuple((a * m + b) % p for a, b, m, p in zip(x, y, s, poly.moduli)) == poly.chunk(data)


def brute_near(rows):
    sets = []
    for i, t in rows:
        w = words_of(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for a, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(a)].append(i)
    return [(i, len(s), c, i == c) for a, ((i, _), s) in enumerate(zip(rows, sets)) for c in [min(ids[find(a)], default=None)]]


def near_rows(n=60, seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    line = " ".join(rng.choices(vocabulary, k=40))
    rows = []
    for family in range(6):
        base = rng.choices(vocabulary, k=150)
        for _ in range(n // 6):
            w = list(base)
            for _ in range(rng.choice((0, 1, 3, 6, 9))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((rng.randrange(10**6), " ".join(w)))
    rows += [(2_000_000 + i, line + " " + " ".join(rng.choices(vocabulary, k=60))) for i in range(15)]
    rows += [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "One  TWO"), (6, "one two three"), (7, "É a b c d e"), (8, "é a b c d e"), (9, "same"), (9, "same"), (None, "one two"), (None, "alone here with null id five"), (10, "x " * 5000)]
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_near_groups(spark, seed):
    rows = near_rows(seed=seed)
    got = near_dedup.near_groups(frame(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_near(rows)))


def test_near_representatives(spark):
    rows = near_rows(12)
    got = near_dedup.representatives(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    assert {r.doc_id for r in got.collect()} == {i for i, _, c, kept in brute_near(rows) if kept or i == c}
    assert near_dedup.near_groups(frame(spark, [])).count() == 0


def test_components_of_paths_and_stars(spark, tmp_path):
    links = [(f"{a:03d}", f"{b:03d}") for a, b in [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (202, 201), (201, 201)]]
    got = dict(components.components(spark.createDataFrame(links, "a string, b string"), Scratch(spark, "test")).collect())
    want = {f"{i:03d}": "000" for i in range(1, 61)} | {f"{i:03d}": "100" for i in range(101, 140)} | {"201": "200", "202": "200"}
    assert got == want


def test_decontamination(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(8, 60)))) for i in range(12)] + [(50, None), (51, ""), (52, "two words"), (None, "a null item of seven words here")]
    docs = [(i, " ".join(rng.choices(vocabulary, k=300))) for i in range(10)]
    for i, t in items[:8]:
        w = t.split()
        docs.append((100 + i, docs[i][1] + " " + t.upper().lower() + " tail"))
        docs.append((200 + i, docs[i][1] + " " + " ".join(w[: len(w) * 4 // 5]) + " more"))
        docs.append((300 + i, " ".join(w[: len(w) // 2])))
    docs += [(None, items[0][1]), (400, None), (401, ""), (402, "Two Words"), (403, "two words more"), (100, docs[10][1])]
    sets = lambda t: {tuple(words_of(t)[k : k + 5]) for k in range(max(1, len(words_of(t)) - 4))} if words_of(t) else set()
    want = {(d, i, len(sets(b)), len(sets(b) & sets(t))) for d, t in docs for i, b in items if sets(b) and 100 * len(sets(b) & sets(t)) >= 75 * len(sets(b))}
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, doc_id string")
    for limit in (10**6, 60):
        got = decontam.contaminated(frame(spark, docs), bench, block_shingles=limit).collect()
        assert {tuple(r)[:4] for r in got} == want and len(got) == len(want)
    clean = decontam.clean(frame(spark, docs), bench).collect()
    assert {r.doc_id for r in clean} == {d for d, _ in docs} - {d for d, *_ in want}
    assert decontam.contaminated(frame(spark, []), bench).count() == 0
    assert decontam.contaminated(frame(spark, docs), bench.limit(0)).count() == 0
    named = bench.selectExpr("concat('item ', item_id) as item_id", "text")
    assert {r.item_id for r in decontam.contaminated(frame(spark, docs), named).collect()} == {f"item {i}" if i is not None else None for _, i, _, _ in want}


def test_item_signatures_by_partition():
    rng = np.random.default_rng(5)
    assert decontam.least_hits(32, 75) > 1 and decontam.least_hits(64, 75) > decontam.least_hits(32, 75)
    vocabulary = rng.integers(1, 1 << 60, 20_000).astype(np.uint64)
    items = [(i, np.unique(rng.choice(vocabulary, n))) for i, n in enumerate([3, 20, 32, 33, 100, 500, 3000] * 6)]
    block = decontam.Block(items, 75)
    for i, s in items:
        part = rng.choice(s, -(-75 * len(s) // 100), replace=False)  # just at the threshold, in a long document
        doc = np.unique(np.concatenate([part, rng.integers(1, 1 << 60, 30_000).astype(np.uint64)]))
        want = {k for k, x in items if 100 * len(np.intersect1d(doc, x)) >= 75 * len(x)}
        assert i in want and {k for k, _ in block.search(doc)} == want


def test_compact_windows_cover_every_span_once():
    rng = np.random.default_rng(0)
    for values in (rng.integers(0, 1 << 60, 90).astype(np.uint64), np.arange(60, dtype=np.uint64)):
        least = 7
        windows = substring_dedup.compact_windows(values, least)
        for a in range(len(values)):
            for b in range(a + least - 1, len(values)):
                c = a + int(values[a : b + 1].argmin())
                assert sum(l <= a and b <= r and w == c for l, w, r in windows) == 1
    assert len(substring_dedup.compact_windows(np.zeros(5000, np.uint64), 50)) <= 101


def passage_rows(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(4000)]
    passages = [rng.choices(vocabulary, k=k) for k in (50, 55, 70, 120)]
    short = rng.choices(vocabulary, k=30)
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(10, 400)))) for i in range(30)]
    for k, p in enumerate(passages):
        for j in range(5):
            rows.append((1000 * (k + 1) + j, " ".join(rng.choices(vocabulary, k=rng.randint(0, 90)) + p + rng.choices(vocabulary, k=rng.randint(0, 90)))))
    rows += [(9000 + j, " ".join(rng.choices(vocabulary, k=60) + short + rng.choices(vocabulary, k=60))) for j in range(6)]
    rows += [(None, rows[-1][1]), (9999, None), (9998, ""), (9997, "q " * 3000), (1000, rows[30][1])]
    return rows


def test_repeated_passages(spark):
    rows = passage_rows()
    seqs = [(i, window_hashes(h).tolist()) for (i, t), h in zip(rows, word_hashes([t for _, t in rows])) if i is not None and t]
    owners = collections.defaultdict(set)
    for i, s in seqs:
        for a in range(len(s) - 45):
            owners[tuple(s[a : a + 46])].add(i)
    want = {i for ids in owners.values() if len(ids) > 1 for i in ids}
    got = substring_dedup.repeated_passages(frame(spark, rows)).collect()
    assert {r.doc_id for r in got} | {r.source_doc_id for r in got} == want
    text = dict(reversed([(i, t) for i, t in rows if t]))
    for r in got:
        if r.similarity == 1.0:
            cut = lambda i, s: text[i].split()[s : s + r.n_words]
            assert cut(r.doc_id, r.start_word) == cut(r.source_doc_id, r.source_start_word)
        assert r.n_words >= 50
    assert substring_dedup.repeated_passages(frame(spark, [])).count() == 0


def test_passages_with_words_put_in_or_left_out(spark):
    rng = random.Random(8)
    vocabulary = [f"e{i}" for i in range(9000)]
    some = lambda k: rng.choices(vocabulary, k=k)
    rows = []
    for k in range(30):
        p = some(60)
        edited = p[:30] + some(1) + p[30:] if k % 2 else p[:29] + p[30:]
        rows += [(2 * k, " ".join(some(40) + p + some(40))), (2 * k + 1, " ".join(some(25) + edited + some(70)))]
    got = substring_dedup.repeated_passages(frame(spark, rows)).collect()
    assert {(r.doc_id, r.source_doc_id) for r in got} == {(2 * k + 1, 2 * k) for k in range(30)}
    assert all(0.75 <= r.similarity < 1 and 50 <= r.n_words <= 65 for r in got)


def test_passages_whose_shingles_all_stand_in_an_earlier_document(spark):
    """The passage is made of overlapping lines, each with another context in earlier documents."""
    rng = random.Random(9)
    vocabulary = [f"h{i}" for i in range(9000)]
    some = lambda k: rng.choices(vocabulary, k=k)
    p = some(60)
    rows = [(i, " ".join(some(60) + p[a : a + 25] + some(60))) for i, a in enumerate(range(0, 36, 5))]
    rows += [(100, " ".join(some(30) + p + some(30))), (101, " ".join(some(50) + p + some(10)))]
    got = substring_dedup.repeated_passages(frame(spark, rows)).collect()
    assert {(r.doc_id, r.source_doc_id, r.n_words) for r in got} == {(101, 100, 60)}


def test_near_passages_whose_group_begins_in_another_context(spark):
    rng = random.Random(23)
    vocabulary = [f"n{i}" for i in range(5000)]
    mixed = lambda k: rng.choices(vocabulary, k=k)
    rows, want = [], set()
    for i in range(6):
        base = mixed(60)
        near = list(base)
        near[30] = f"changed{i}"  # no run of 50 words is equal, 51 of 61 shingles are
        # an earlier document has every part of the passage, each in another context
        rows += [(i, " ".join(w for k in range(0, 60, 10) for w in [*base[max(k - 4, 0) : k + 14], *mixed(50)]))]
        rows += [(100 + i, " ".join(mixed(70) + base + mixed(70))), (200 + i, " ".join(mixed(40) + near + mixed(90)))]
        want.add((200 + i, 100 + i))
    got = {(r.doc_id, r.source_doc_id) for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert want <= got


def test_sequences_are_shuffled_once_for_both_sides(spark):
    scratch = Scratch(spark, "test")
    pairs = scratch.table(spark.range(100).selectExpr("id", "id + 1 as fid", "1 as lo", "2 as hi", "3 as flo", "4 as fhi"), "pairs")
    seqs = scratch.table(spark.range(101).selectExpr("id", "cast(concat_ws('', transform(sequence(0, 9), i -> lpad(cast(10 * id + i as string), 4, '0'))) as binary) as seq"), "sequences")
    got = substring_dedup.with_sequences(pairs.hint("merge"), seqs.hint("merge"))
    for r in got.collect():
        assert (r.fid, bytes(r.x).decode(), bytes(r.y).decode()) == (r.id + 1, f"{10 * r.id + 1:04d}{10 * r.id + 2:04d}", f"{10 * r.fid + 3:04d}{10 * r.fid + 4:04d}")
    assert got.count() == 100
    assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()


def test_similar_runs_tell_shingles_of_equal_lower_bits_apart():
    x = np.arange(60, dtype=np.uint32)
    assert substring_dedup.similar_runs(x, x + np.uint32(1 << 16), 46, 75) == []
    assert substring_dedup.similar_runs(x, x, 46, 75) == [(0, 60, 0, 60, 1.0)]
    y = np.concatenate([x[:30] + np.uint32(1 << 16), x, x[:9]])
    assert substring_dedup.similar_runs(x, y, 46, 75) == [(0, 60, 30, 90, 1.0)]
    assert substring_dedup.similar_runs(x[:0], x, 46, 75) == substring_dedup.similar_runs(x, x[:0], 46, 75) == []


def test_a_written_table_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = shuffled()
    Scratch(spark, "test").table(spark.range(1000).groupBy(F.expr("id % 7 as k")).count(), "counts")
    for _ in range(50):  # they go in the background
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before


def test_repeated_rows_of_one_id_keep_each_text(spark):
    rows = [(13, "a"), (13, "a"), (13, "b"), (13, "b"), (None, "c"), (None, "c"), (None, "d"), (None, "d"), (1, "e"), (2, "a")]
    got = exact_dedup.deduplicated(frame(spark, rows))
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == [("1", "e"), ("13", "b"), ("2", "a"), ("None", "c"), ("None", "d")]


def test_word_hashes_follow_words():
    texts = [None, "", " \t", "One  TWO\nthree", "one two\x0bthree", "É é \u2003x", "a" * 70_000 + " b", "ab ba", "x " * 300]
    got = word_hashes(texts)
    want = [words_of(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    by_hash = {}
    for g, w in zip(got, want):
        for h, word in zip(g.tolist(), w):
            assert by_hash.setdefault(h, word) == word
    assert len(by_hash) == len({w for ws in want for w in ws})
