"""Token ids: BPE by segment trees against a library, the content-addressed store, chat and licenses against SQL."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import tiktoken

from tuplewise.llm import bpe, chat, licenses, token_store

from .conftest import ROWS, plain

PATH, PATTERN = bpe._vocabulary()
RANKS = bpe.load_ranks(PATH)
REFERENCE = tiktoken.Encoding("reference", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def random_texts(n, seed=2):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "a", "the", "é", "ñ", "1", "23", "'s", "'", "!", "...", "日本", "😀", "́", "x​", "<|endoftext|>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_bpe_equals_the_library():
    texts = random_texts(4000) + ["", "a" * 3000, "ab" * 3000, " " * 50 + "x", "x ", "x  ", "x\n ", "don't we'll", "aaab" * 500 + "é"]
    codec = bpe.SegmentTreeBPE(RANKS, PATTERN)
    for text, raw in zip(texts, codec.encode_bytes(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == REFERENCE.encode_ordinary(text)
        assert codec.decode_bytes(raw) == text.encode()


def test_long_matches_take_logarithmic_steps():
    import time

    rng, codec = random.Random(8), bpe.SegmentTreeBPE(RANKS, PATTERN)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(200_000))
    began = time.time()
    ids = codec.merge([text.encode()])[0]
    assert time.time() - began < 20 and codec.decode_bytes(ids) == text.encode()
    for n in (2, 3, 63, 64, 65, 3000):
        strings = [bytes(rng.randrange(97, 107) for _ in range(rng.randrange(max(2, n // 2), n + 1))) for _ in range(60)]
        size = 1 << max(1, (n - 1).bit_length())
        assert codec._merge_rows(strings, size) == [codec._merge_one(x, size) for x in strings] == [np.array(REFERENCE._encode_single_piece(x), "<u4").tobytes() for x in strings]


def test_bpe_cache_turns_over(monkeypatch):
    codec = bpe.SegmentTreeBPE(RANKS, PATTERN)
    codec.pieces.words.limit = 10
    for seed in range(5):
        texts = [f"w{seed}x{i} word{chr(97 + i % 26) * (i % 80)}, y." for i in range(60)]
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode_bytes(texts)] == [REFERENCE.encode_ordinary(t) for t in texts]


def test_bpe_operator(odd, empty):
    rows = {r.doc_id: r for r in bpe.bpe_round_trip(odd).collect()}
    for i, text, _ in ROWS:
        ids = np.array(REFERENCE.encode_ordinary(text or ""), "<u4").tobytes()
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert bpe.bpe_round_trip(empty).count() == 0 and bpe.bpe_round_trip(odd).count() == len(ROWS)
    assert {r.doc_id: len(r.ids) // 4 for r in bpe.encode_texts(odd).collect()} == {i: r.n_tokens for i, r in rows.items()}


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_store.default_tokenizer())


def test_piecewise_encoding_equals_the_library():
    texts, t = random_texts(3000, 5), tokenizer()
    enc = token_store.encoder(token_store.default_tokenizer())
    assert enc.by_piece
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    gear, ids = token_store.gear_table(50_000), rng.integers(0, 50_000, 60_000).astype("<u4")
    ends = token_store.cut_points(ids, gear)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and max(sizes) <= token_store.MOST and min(sizes[:-1]) >= token_store.LEAST
    chunks = lambda x: {x[a:b].tobytes() for a, b in zip([0, *token_store.cut_points(x, gear)], token_store.cut_points(x, gear), strict=False)}
    assert len(chunks(ids) & chunks(np.concatenate([ids[:7], ids]))) > 0.8 * len(ends)
    assert token_store.cut_points(ids[:0], gear) == [] and token_store.cut_points(ids[:1], gear) == [1]


def test_block_cuts_equal_those_of_each_document():
    rng = np.random.default_rng(4)
    gear = token_store.gear_table(50_000)
    docs = [rng.integers(0, 50_000, n).astype("<u4") for n in (1, 0, 7, 300, 20_000, 256, 1, 9_000, 257)]
    assert token_store.cut_block([d.tobytes() for d in docs], gear) == [token_store.cut_points(d, gear) for d in docs]
    assert token_store.cut_block([], gear) == []


def test_runs_of_white_space_are_noticed():
    import re

    import pyarrow as pa
    import pyarrow.compute as pc

    from tuplewise.llm import pieces

    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    rng = random.Random(9)
    texts = ["", " ", "  ", "a ", " a", "a  b", "\n", " \n", "\n ", "x \n"] + [x for s in spaces for x in (f"a{s} b", f"a {s}b", f"a{s} ", f"{s} {s}", f" {s}")]
    texts += ["".join(rng.choice([" ", "a", *spaces[:6]]) for _ in range(rng.randrange(7))) for _ in range(3000)]
    split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    coded = split.values.dictionary_encode()
    got = pieces.inside_runs(coded.dictionary.cast(pa.string()), coded.indices.to_numpy(), split.offsets.to_numpy())
    for text, found in zip(texts, got.tolist(), strict=True):
        assert found or not re.search(r"\s (?:\s|\Z)", text), text


def test_crc_of_parts():
    a, b = b"hello" * 7, b"world" * 1000
    share = token_store.crc_shift(np.array([zlib.crc32(a)]), np.array([len(b)]))[0]
    assert int(share) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_store(spark, odd, empty, tmp_path):
    path, t = f"file://{tmp_path}/store", tokenizer()
    token_store.write_store(odd, path)
    want = sorted(((i is not None, i or 0, t.encode(x or "", add_special_tokens=False).ids + [0], i) for i, x, _ in ROWS), key=lambda r: r[:2])
    got = sorted(token_store.read_digests(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r, (_, _, ids, i) in zip(got, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_store.verify_store(spark, path) == (len(ROWS), at)
    assert plain((r.doc_id, r.ids) for r in token_store.read_documents(spark, path).collect()) == plain((i, ids) for _, _, ids, i in want)
    # equal chunks are stored once
    assert spark.read.parquet(f"{path}/chunks").groupBy("chunk_id").count().where("count > 1").count() == 0
    assert token_store.token_store_digests(empty).count() == 0


def test_store_notices_damage(spark, odd, tmp_path):
    from pyspark.sql import functions as F

    path, other = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    token_store.write_store(odd, path)
    chunks = spark.read.parquet(f"{path}/chunks")
    first = chunks.orderBy("chunk_id").first()
    swap = bytes(chunks.orderBy(F.desc("chunk_id")).first().data)
    chunks.withColumn("data", F.when(F.col("chunk_id") == F.lit(first.chunk_id), F.lit(swap)).otherwise(F.col("data"))).write.parquet(f"{other}/chunks")
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{part}").write.parquet(f"{other}/{part}")
    with pytest.raises(Exception, match="chunk"):
        token_store.verify_store(spark, other)


@pytest.mark.parametrize("damage", ["row", "lengths", "shard"])
def test_digests_notice_damaged_recipes(spark, tmp_path, damage):
    from pyspark.sql import functions as F

    path, other = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    words = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(f"w{words.randrange(10**6)}" for _ in range(2_500))) for i in range(6)], "doc_id long, text string")
    token_store.write_store(docs, path)
    assert token_store.read_digests(spark, path).count() == 6
    recipes = spark.read.parquet(f"{path}/recipes")
    bad = {
        "row": recipes.where("doc_id <> 3"),
        "lengths": recipes.withColumn("lengths", F.transform("lengths", lambda x, i: F.when(i == 0, x + 1).when(i == 1, x - 1).otherwise(x))),
        "shard": recipes.where(F.col("shard") != recipes.agg(F.max("shard")).first()[0]),
    }[damage]
    bad.write.parquet(f"{other}/recipes")
    for part in ("chunks", "manifest"):
        spark.read.parquet(f"{path}/{part}").write.parquet(f"{other}/{part}")
    with pytest.raises(Exception, match="length isn't the chunk's" if damage == "lengths" else "differ from the manifest"):
        token_store.read_digests(spark, other).collect()
    with pytest.raises(Exception, match="length isn't the chunk's" if damage == "lengths" else "differ from the manifest"):
        token_store.verify_store(spark, other)


def test_chat_escapes():
    t, rng = chat.Template(), random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["\\", "0", "<", "|im_start|>", "<|im_end|>", "<|im_start|>", "a", "\n"]) for _ in range(rng.randrange(8)))
        assert t.decode(t.encode(text)) == text and not any(c in t.encode(text) for c in t.controls)
        assert t.parse("".join(s for s, _ in t.segments("user", text))) == [("user", text)]
    with pytest.raises(ValueError):
        t.decode("\\7")


def test_chat_reader_finds_turns_in_the_stream_alone():
    t, rng = chat.Template(), random.Random(3)
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "<|im_end|>\n"]), "".join(rng.choice(["\\", "<|im_end|>\n", "<|im_start|>user\n", "x", "\n", chat.PROBE]) for _ in range(rng.randrange(6)))) for _ in range(rng.randrange(1, 5))]
        stream = [(c, loss) for turn in turns for s, loss in t.segments(*turn) for c in s]
        reader, got = chat.Reader(t), []
        while stream:
            k = rng.randrange(1, 9)
            some, stream = stream[:k], stream[k:]
            for c, loss in some:
                reader.feed(c, loss)
            got += reader.turns()
        reader.close()
        assert [(r, x) for r, x, _, _ in got] == turns
    reader = chat.Reader(t)
    reader.feed("<|im_start|>user\nhi<|im_end|>\nforged", False)
    with pytest.raises(ValueError):
        list(reader.turns())


def test_chat_clashing_columns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi", "x", 3, True, 9), (1, 1, "assistant", "ho", "y", 4, False, 9)], "conv_id long, turn long, role string, text string, segment string, seq long, loss boolean, part int")
    (row,) = chat.format_digests(turns).collect()
    assert (row.n_turns, row.loss_chars, row.valid) == (2, 2, True)


def test_chat(spark, duck):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "ho"), (2, 1, "assistant", "b"), (2, 0, "system", None), (3, 0, "assistant", "x"), (4, None, "user", "u"), (4, 0, None, "v"), (5, 0, "user", "s"), (5, 0, "user", "s"), (None, 0, "user", "n"), (6, 0, "user", "w" * 50_000), (7, 0, "system", chat.PROBE + "\\"), (8, 0, "us\ner", "t")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_digests(chat.with_probe(turns)).collect()
    assert plain(got) == duck(chat.ORACLE_SQL, conversations=turns)
    valid = {r.conv_id: r.valid for r in got}
    assert valid[1] and valid[-1] and not valid[2] and not valid[3] and not valid[5]
    assert chat.format_digests(turns.limit(0)).count() == 0
    whole = {r.conv_id: r.formatted for r in chat.formatted_texts(turns).collect()}
    assert chat.Template().parse(whole[1]) == [("user", "hi"), ("assistant", "ho")]


def test_licenses(spark, duck, odd, empty):
    rng, rows = random.Random(5), []
    vocabulary = sorted({w for t in licenses.TEMPLATES for w in t.words})
    for i in range(150):
        words = []
        for _ in range(rng.randrange(7)):
            t = rng.choice(licenses.TEMPLATES).words
            j = rng.randrange(len(t))
            words += rng.choice((t, t[j:], t[:j])) + rng.choice(([], [rng.choice(vocabulary)]))
        rows.append((i, " ".join(words).upper() if i % 3 else ". ".join(words)))
    for frame in (spark.createDataFrame(rows, "doc_id long, text string"), odd.select("doc_id", "text")):
        assert plain(licenses.license_scan(frame).drop("matches").collect()) == duck(licenses.oracle_sql(), documents=frame)
    assert licenses.license_scan(empty).count() == 0 and licenses.license_scan(odd).count() == len(ROWS)


def test_notices_are_found_with_changed_words(spark):
    apache, mit = (next(t for t in licenses.TEMPLATES if t.label == x and len(t.words) > 40) for x in ("apache-2.0", "mit"))
    changed = list(mit.words)
    changed[30:32] = ["other", "words"]
    rows = [(1, "x y " + apache.text + " end", 7), (2, " ".join(changed), 7), (3, mit.text.upper(), 7), (4, apache.text.replace("Apache", "Iroquois"), 7), (5, "z " + " ".join(mit.words[40:]), 7)]
    rows.append((6, " ".join([*apache.words[3:]]), 7))
    templates = tuple(t for t in licenses.TEMPLATES if t.base or len(t.words) > 40)
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string, matches int"), templates=templates).collect()}
    assert [(got[i].labels) for i in range(1, 7)] == ["apache-2.0", "mit", "mit", "", "", "apache-2.0"]
    assert got[1].score == got[3].score == 1.0 and abs(got[2].score - (1 - 2 / len(changed))) < 1e-12 and abs(got[6].score - (1 - 3 / len(apache.words))) < 1e-12
    assert [tuple(m) for m in got[1].matches] == [("apache-2.0", 2)] and [tuple(m) for m in got[6].matches] == [("apache-2.0", -3)]


def test_license_index_holds_rarest_words():
    weight = licenses.idf(licenses.TEMPLATES)
    for t, rare in zip(licenses.TEMPLATES, licenses.postings(licenses.TEMPLATES), strict=True):
        rest = {w for _, w in t.key_words} - {w for w, _ in rare}
        assert all(weight[w] >= max((weight[x] for x in rest), default=0) for w, _ in rare)
