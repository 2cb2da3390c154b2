"""SimHash classes, components, decontamination and the pipeline against brute force."""

import itertools
import random

import xxhash

from tuplewise.llm import components, decontaminate, simhash

from .conftest import ROWS, plain


def union(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints(docs):
    for r in docs.limit(40).collect():
        assert simhash.shingle_fingerprint(r.text) == brute_fingerprint(r.text)
    for t in (None, "", "A", "a\x0bB", "É é É"):
        assert simhash.shingle_fingerprint(t) == brute_fingerprint(t)


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("the cat sat",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got & (2**64 - 1) == xxhash.xxh64_intdigest(b"the cat sat", seed=42)


def test_bk_tree_finds_all_within_radius():
    rng = random.Random(3)
    values = [rng.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert {tree.values[i] for i in tree.within(q, 2)} == {v for v in values if (v ^ q).bit_count() <= 2}


def test_links_keep_every_class_at_any_shard_size(spark):
    rng, fps = random.Random(4), set()
    while len(fps) < 250:
        center = rng.getrandbits(64)
        for _ in range(rng.choice((1, 2, 40))):
            x = center
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    roots = union(len(fps), [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2])
    want = {frozenset(f for f, r in zip(fps, roots, strict=True) if r == k) for k in set(roots)}
    frame = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    for shard in (1024, 64, 12):
        groups = {}
        for r in components.connected_components(simhash.fingerprint_links(frame, shard)).collect():
            groups.setdefault(r.component, set()).add(r.node & (2**64 - 1))
        assert {frozenset(g) for g in groups.values()} == {g for g in want if len(g) > 1}


def test_tables_of_shards_lose_no_link():
    rng = random.Random(6)
    for n in (10, 5_000, 10**7, 10**12):
        cuts = simhash.first_cuts(n, 1024)
        for _ in range(20):
            x = rng.getrandbits(64)
            y = x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            level = cuts
            for _ in range(9):
                level = [c for c in level if not (x ^ y) & c.mask]
                assert level
                level = [p for c in level for p in c.parts()]


def test_trees_hold_every_fingerprint(monkeypatch):
    rng, seen = random.Random(7), []
    add = simhash.BKTree.add
    monkeypatch.setattr(simhash.BKTree, "add", lambda self, v: (seen.append(v), add(self, v))[1])
    for size in (2, 3, 50):
        values = [rng.getrandbits(64) for _ in range(size)]
        seen.clear()
        simhash.shard_links(values)
        assert seen == values


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(500, 500), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **{100 + i: 100 for i in range(60)}}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    fps = [brute_fingerprint(t) for _, t, _ in ROWS]
    roots = union(len(ROWS), [(i, j) for i, j in itertools.combinations(range(len(ROWS)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = {k: min((ROWS[i][0] for i in range(len(ROWS)) if roots[i] == k and ROWS[i][0] is not None), default=None) for k in set(roots)}
    want = plain((i, f"{fp:016x}", least[r]) for (i, _, _), fp, r in zip(ROWS, fps, roots, strict=True))
    assert plain(rows) == want and simhash.near_duplicates(empty).count() == 0


def test_contamination(spark, duck, odd, empty):
    rng = random.Random(3)
    vocabulary = ["a", "B", "c", "é", "7"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = spark.createDataFrame([(i, text(rng.choice((0, 1, 3, 12, 13, 14, 40, 200)))) for i in range(60)] + [(5, None), (None, "a b c"), (7, "a " * 200)], "doc_id long, text string")
    items = spark.createDataFrame([(i, text(rng.choice((0, 2, 6, 12, 13, 14, 30)))) for i in range(15)] + [(90, None), (91, "A " * 30), (92, "a " * 30)], "item_id long, text string")
    for limit in (decontaminate.BROADCAST_BYTES, 0):
        assert plain(decontaminate.contamination(docs, items, broadcast_bytes=limit).collect()) == duck(decontaminate.ORACLE_SQL, documents=docs, benchmark=items)
    assert decontaminate.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, items).count() == 0
    assert plain(decontaminate.contamination(odd, items).collect()) == duck(decontaminate.ORACLE_SQL, documents=odd.select("doc_id", "text"), benchmark=items)
    assert decontaminate.drop_contaminated(odd, items).columns == odd.columns


def test_every_span_of_13_words_is_found(spark):
    rng = random.Random(8)
    item = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    rows = [(i, " ".join([*(f"x{rng.randrange(10**6)}" for _ in range(i % 9)), *item[i : i + 13], "end"])) for i in range(28)] + [(100 + i, " ".join(item[i : i + 12])) for i in range(29)]
    got = {r.doc_id: r.n_hit for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {**{i: 13 for i in range(28)}, **{100 + i: 0 for i in range(29)}}


def test_long_text_and_items_of_every_length(spark, duck):
    import time

    rng = random.Random(11)
    words = [f"w{rng.randrange(4_000)}" for _ in range(100_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[7:60]))], "doc_id long, text string")
    items = spark.createDataFrame([(n, " ".join(words[50 * n : 51 * n])) for n in range(1, 31)], "item_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert time.time() - began < 60
    want = set()
    for n in range(1, 31):
        for k in range(max(1, n - 12)):
            win = words[50 * n + k : 50 * n + k + min(n, 13)]
            want |= {p for i in range(len(words) - len(win) + 1) if words[i] == win[0] and words[i : i + len(win)] == win for p in range(i, i + len(win))}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items) == (100_000, len(want), 30)


def test_chunks_change_nothing(spark, monkeypatch):
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice("abcdefg") + str(rng.randrange(3)) for _ in range(n))
    docs = spark.createDataFrame([(i, text(rng.randrange(120))) for i in range(80)], "doc_id long, text string")
    items = spark.createDataFrame([(i, text(n)) for i, n in enumerate((1, 2, 3, 7, 12, 13, 20, 40))] + [(50, docs.first().text)], "item_id long, text string")
    whole = plain(decontaminate.contamination(docs, items).collect())
    monkeypatch.setattr(decontaminate, "CHUNK", 17)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 1 << 12)
    assert plain(decontaminate.contamination(docs, items).collect()) == whole


def test_rows_are_dropped_by_their_own_text(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(None, item), (None, "clean text"), (5, item + " x"), (5, "clean too"), (6, None), (7, "")]
    kept = decontaminate.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert plain(kept.collect()) == plain([(None, "clean text"), (5, "clean too"), (6, None), (7, "")])
