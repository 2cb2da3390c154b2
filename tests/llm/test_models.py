"""Language identification and quality: held-out accuracy, and odd cases."""

import zlib

import numpy as np

from tuplewise.llm import langid, quality

from .conftest import DATA, ROWS


def test_languages_of_held_out_documents(docs):
    found = {r.doc_id: r for r in langid.language_table(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i].held_out == (i in set(held)) for i in truth)
    assert np.mean([found[i].lang_pred == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_margins_are_linear(docs):
    rows = docs.limit(120).collect()
    texts = [r.text for r in rows] + ["", " ", "12", "é"]
    model = langid.fit(langid.features(texts[:120]), [r.lang for r in rows])
    assert np.allclose(langid.features(texts) @ model.weights + model.offsets, model.margins(texts), atol=1e-4)


def test_language_odd_cases(odd, empty):
    rows = langid.language_table(odd).collect()
    assert len(rows) == len(ROWS) and langid.language_table(empty).count() == 0
    for r in rows:
        if r.doc_id in (3, 4, 5):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "de", "fr", "es", "und")
    nothing = odd.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in langid.language_table(nothing).collect()} == {"und"}
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and not {3, 4, 5} & {r.doc_id for r in kept.collect()}


def plain_language(text, model):
    """Trigrams counted one by one, every machine asked in turn."""
    low = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in text.lower().encode())
    b = b" " + b" ".join(low.split()) + b"  "
    grams = [(b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32 >> 20 for i in range(len(b) - 2)]
    margin = {t: sum(float(model.weights[g, k]) for g in grams) * langid.SCALE / len(grams) + model.offsets[k] for k, t in enumerate(model.teams)}

    def duel(group, names):
        beats = lambda a, c: margin[group, a, c] if (group, a, c) in margin else -margin[group, c, a]
        return max(names, key=lambda a: sum((beats(a, c) > 0) + 0.001 * np.tanh(beats(a, c)) for c in names if c != a))

    return duel(duel("", model.families), model.langs[duel("", model.families)])


def test_language_equals_a_plain_version(docs):
    model = langid.train(docs)
    texts = [r.text for r in docs.limit(150).collect() if r.text]
    assert model.predict(texts)[0] == [plain_language(t, model) for t in texts]


def test_long_texts_in_chunks(docs, monkeypatch):
    model, text = langid.train(docs), "Das ist ein langer Text und the other words, par les mots. " * 900
    whole, bag_whole = model.margins([text, "x", text[:-9]]), quality.shares(text)
    monkeypatch.setattr(langid, "CHUNK", 1000)
    monkeypatch.setattr(quality, "SLICE", 1000)
    assert np.allclose(whole, model.margins([text, "x", text[:-9]])) and np.allclose(langid.features([text]), langid.features([text]))
    places, shares = quality.shares(text)
    assert (places == bag_whole[0]).all() and np.allclose(shares, bag_whole[1])
    weights = np.random.default_rng(1).normal(size=quality.BUCKETS + 1).astype("f4")
    one = quality.score_texts(["same same " * 800, "b"], weights, 0.1)
    monkeypatch.undo()
    assert np.allclose(one, quality.score_texts(["same same " * 800, "b"], weights, 0.1))
    # a word of any length has a hash of all its bytes
    assert quality.shares("y" * 9000 + "z")[0].tolist() != quality.shares("y" * 9000 + "x")[0].tolist()


def plain_bag(text):
    """Features of a text one by one: words, n-grams of words with their spaces, repeats."""
    out, words = [], text.encode().split()
    for w in words:
        padded = b" " + w + b" "
        for n in quality.NGRAMS:
            out += [int.from_bytes(g) + (n << 40) for i in range(len(padded) - n + 1) for g in [padded[i : i + n]] if not (g[:1] == b" " and g[-1:] == b" ")]
    hashed = [k * 0x9E3779B97F4A7C15 % 2**64 >> 48 for k in out]
    power = [pow(0x100000001B3, i % 4096 + 1, 2**64) for i in range(max(map(len, words), default=0))]
    hashed += [sum((c + 1) * power[i] for i, c in enumerate(w)) % 2**64 * 0x9E3779B97F4A7C15 % 2**64 >> 48 for w in words]
    return sorted(hashed + [quality.BUCKETS for a, b in zip(words, words[1:], strict=False) if a == b])


def test_bags_equal_a_plain_version(docs):
    texts = [r.text or "" for r in docs.limit(60).collect()] + ["", "a", "a a  a", "é\u2003x", "z" * 5000]
    for t in texts:
        assert sorted(quality.bag([t])[0].tolist()) == plain_bag(t)
    buckets, owner = quality.bag(texts)
    for i, t in enumerate(texts):
        assert sorted(buckets[owner == i].tolist()) == plain_bag(t)


def test_samples_are_bounded(spark):
    rows = spark.createDataFrame([(1, "der die das", "de")] * 300 + [(2, "the a an", "en")] * 300, "doc_id long, text string, lang string")
    from tuplewise.llm import samples

    assert samples.bounded(rows, 7).count() == 7
    langid.train(rows, per_lang=5)
    labels = rows.selectExpr("doc_id", "doc_id % 2 AS quality")
    assert len(quality.train(rows, labels, per_class=5).classes) <= 2


def test_families():
    assert langid.family_of("en") == langid.family_of("de") != langid.family_of("fr") and langid.family_of("xx") == "xx"


def test_quality_of_held_out_documents(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    found = {r.doc_id: r for r in quality.quality_table(docs, labels).collect()}
    held = [i for i in truth if i in found and zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i].held_out for i in held) and np.mean([found[i].predicted == truth[i] for i in held]) > 0.9
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert all(i in kept for i in truth if truth[i] == 1 and i in found)


def test_quality_folded_scores_equal_the_network():
    rng = np.random.default_rng(0)
    m = quality.Model([0, 1], rng.normal(size=(quality.BUCKETS + 1, 16)).astype("f4"), rng.normal(size=(16, 2)).astype("f4"), rng.normal(size=2).astype("f4"))
    texts = ["", "a b a a", " é  x\n", "x" * 9000, "Same same same Same"]
    for text, got in zip(texts, quality.score_texts(texts, *m.folded()), strict=True):
        places, shares = quality.shares(text)
        logits = (shares @ m.vectors[places] if len(places) else np.zeros(16)) @ m.layer + m.offset
        p = np.exp(logits - logits.max())
        assert abs(got - p[1] / p.sum()) < 1e-4


def test_quality_odd_cases(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (8, 0, 0), (8, 0, 1), (99, 0, 0), (None, 0, 0), (11, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_table(odd, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality_table(empty, labels).count() == 0
    assert len({r.score for r in quality.quality_table(odd, labels.limit(0)).collect()}) == 1
    assert quality.keep_good(odd, labels, min_score=0.0).columns == odd.columns
