"""Near copies by shingle sets against brute force."""

import random

import numpy as np

import corpus_pipeline
from tuplewise.llm import near_copies

from .conftest import DATA
from .test_dedup import union


def brute(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def classes(rows):
    sets = [brute(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    roots = union(len(rows), links)
    least = {k: min((rows[i][0] for i in range(len(rows)) if roots[i] == k and rows[i][0] is not None), default=None) for k in set(roots)}
    return [least[r] for r in roots]


def edited(rng):
    """Texts with few to many changed words, chains of edits and a passage that all share."""
    common = [f"c{i}" for i in range(20)]
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((1, 4, 5, 6, 30, 90, 200)))] + common
        for k in range(14):
            words = list(base)
            for _ in range(rng.randrange(k // 3 + 1)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
            if k > 7:
                base = words
    return rows + [(None, rows[0][1].upper()), (None, None), (900, ""), (901, "only three words"), (902, "only  three\nWORDS")]


def test_all_pairs_of_four_fifths_are_linked(spark):
    rows = edited(random.Random(5))
    got = sorted(map(str, ((r.doc_id, r.component_id) for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    want = classes(rows)
    assert got == sorted(str((i, c)) for (i, _), c in zip(rows, want, strict=True)) and 20 < len(set(want)) < len(rows) - 40


def test_every_text_is_counted(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40))) for _ in range(300)] + [None, ""]
    got = near_copies.bin_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(7), "text")
    want = np.zeros(1 << near_copies.BIN_BITS, np.int64)
    for t in texts:
        np.add.at(want, near_copies.bins_of(near_copies.shingle_set(t)), 1)
    assert (got == want).all() and got.sum() == sum(len(brute(t)) for t in texts)
    assert not near_copies.bin_counts(spark.createDataFrame([], "text string"), "text").any()


def test_forest_and_the_rest_reach_every_passing_pair():
    rng = np.random.default_rng(3)
    parity = rng.integers(0, 2**63, (60, near_copies.PARITY // 64), dtype=np.int64).astype(np.uint64)
    parity[20:] = parity[0]
    n = rng.integers(100, 130, 60)
    pairs = {(j, i) for i in range(60) for j in range(i) if near_copies._pass(n, parity, i)[j]}
    assert set(near_copies.across(n, parity, np.arange(60))) == pairs
    some = list(near_copies.forest(n, parity, np.arange(60)))
    whole, part = union(60, pairs), union(60, some)
    assert set(some) <= pairs and len(some) < 60 and len(set(whole)) == len(set(part)) == len(set(zip(whole, part, strict=True)))


def test_stage_keeps_one_of_near_copies(spark, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = [i for (i, _), c in zip(rows, classes(rows), strict=True) if i == c]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()) == want


def test_keep_one_judges_rows_not_ids(spark, odd):
    kept = near_copies.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    # 1 and 2 are copies, 3 and 4 are both without words, 9 stands twice, and 10 to 12 and the row without an id are alone
    assert ids.count(1) == 1 and 2 not in ids and (3 in ids) + (4 in ids) == 1 and ids.count(9) == 1 and ids.count(None) == 1
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (None, long), (None, long + " more"), (None, "a b c"), (None, "a b c"), (7, "d e f"), (7, "g h i"), (7, "g h i"), (8, "g h i")]
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(1, long), (None, "a b c"), (7, "d e f"), (7, "g h i")]))
