"""Near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, all of them.

SimHash alone can't find these: at a similarity of 0.8 fingerprints differ in some 10 of 64 bits. So the stage has two steps.
First the SimHash operator's links (BK-trees, simhash.py) over 5-word shingles propose pairs. Then prefix filtering finds the rest and loses no
pair: in any one order of all shingles, two sets with a similarity of 4/5 share one of the first n - ceil(4n/5) + 1 of each. The order
puts frequent shingles last, so common passages make no groups. Every text is counted, in bins of the shingles' hashes; any order gives the same links.

Inside a group of sets that share such a shingle, 512 parity bits of each set are compared: those that differ are at
most as many as the shingles that only one set has, and similar sets have at most a ninth of both their sizes of these. Every
proposed pair is confirmed on the whole sets.

What moves: proposals come from the SimHash links and, as a forest, from the groups of sets with a common shingle. Classes of those that are
confirmed are folded; then only groups of more than one class are looked at, for pairs across classes. So a large group of near copies costs
links in proportion to its rows, no link is left out, and whole texts (compressed) go only where a proposal names them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, blocks, drop_path, durable, durable_at, fresh, give_back, map_texts, quoted, ship_package
from .components import connected_components
from .simhash import SHARD, fingerprint_links, fingerprint_of, signed

WORDS, PARITY, SEED = 5, 512, 42
#: Bins of shingles, as bits of their hashes, and bins that travel in one row: their counts over all texts set the order only.
BIN_BITS, BINS_A_ROW = 18, 1 << 12


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct XXH64 of the 5-word shingles; no words: that of nothing."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").decode("utf-8", "replace").split()
    grams = map(" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False)) if len(words) >= WORDS else [" ".join(words)]
    return np.unique(np.frombuffer(b"".join(xxhash.xxh64_digest(g, SEED) for g in grams), np.dtype(">u8")).astype(np.uint64))


def set_key(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def bins_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def bin_counts(df: DataFrame, text_col: str) -> np.ndarray:
    """How many shingles of all texts' sets fall in each bin; rows of equal texts count each."""
    ship_package(df.sparkSession)
    parts = (1 << BIN_BITS) // BINS_A_ROW

    def rows(counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([c.tobytes() for c in counts.reshape(parts, -1)], pa.binary())], names=["part", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BIN_BITS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for _, part in blocks(batch.column(0).slice(at, 64).to_pylist()):
                    counts += np.bincount(bins_of(np.concatenate([shingle_set(t) for t in part])), minlength=len(counts))
        yield rows(counts)
        give_back()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(held, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], names=["part", "counts"])

    schema = "part int, counts binary"
    counted = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, schema)
    out = np.zeros((parts, BINS_A_ROW), np.int64)
    for part, held in counted.repartition("part").mapInArrow(total, schema).collect():  # a row for each part
        out[part] = np.frombuffer(held, np.int64)
    return out.reshape(-1)


def prefixes(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """(key, n, fp, parity, prefix) of each text's set, behind the columns of `keep`."""
    counts = bin_counts(df, text_col)

    def make():
        def work(texts):
            out = {"key": [], "n": [], "fp": [], "parity": [], "prefix": []}
            for _, part in blocks(texts):
                for text in part:
                    s = shingle_set(text)
                    rank = counts[bins_of(s)]
                    out["key"].append(set_key(s))
                    out["n"].append(len(s))
                    out["fp"].append(signed(fingerprint_of(s.astype(">u8").tobytes())))
                    odd = np.bincount((s & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
                    out["parity"].append(np.packbits(odd.astype(np.uint8)).tobytes())
                    out["prefix"].append(s[np.lexsort((s, rank))[: prefix_length(len(s))]].view(np.int64))
            return out

        return work

    return map_texts(df, keep, text_col, "key long, n int, fp long, parity binary, prefix array<long>", make)


def _pass(n: np.ndarray, parity: np.ndarray, i: int, start: int = 0) -> np.ndarray:
    """Which of start..i-1 may be similar to i."""
    differ = np.bitwise_count(parity[start:i] ^ parity[i]).sum(axis=1, dtype=np.int64)
    return 9 * np.maximum(differ, np.abs(n[start:i] - n[i])) <= n[start:i] + n[i]


def forest(n: np.ndarray, parity: np.ndarray, classes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs that may be similar, enough to reach all that such pairs join; neighbours first, so no row is in many."""
    root, parts = list(range(len(n))), 0

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(n)):
        parts += 1
        for start in (max(i - 1, 0), 0):
            if parts == 1:
                break
            for j in (np.flatnonzero(_pass(n, parity, i, start))[::-1] + start).tolist():
                a, b = find(i), find(j)
                if a != b:
                    root[a] = b
                    parts -= 1
                    yield j, i


def across(n: np.ndarray, parity: np.ndarray, classes: np.ndarray) -> Iterator[tuple[int, int]]:
    """All pairs of different classes that may be similar."""
    if (classes != classes[0]).any():
        for i in range(1, len(n)):
            for j in np.flatnonzero(_pass(n, parity, i) & (classes[:i] != classes[i])).tolist():
                yield j, i


def _group_pairs(members: DataFrame, pairs_of: Callable) -> DataFrame:
    """(u, v), u < v: pairs_of() over each shingle's rows of (shingle, key, n, parity, class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
            shingle, key, n, of = (t.column(i).to_numpy() for i in (0, 1, 2, 4))
            parity = np.frombuffer(b"".join(t.column(3).to_pylist()), np.uint64).reshape(len(key), PARITY // 64)
            edges = [0, *(np.flatnonzero(shingle[1:] != shingle[:-1]) + 1).tolist(), len(key)]
            us, vs = [], []
            for a, b in zip(edges, edges[1:], strict=False):
                for i, j in pairs_of(n[a:b].astype(np.int64), parity[a:b], of[a:b]):
                    us.append(key[a + i])
                    vs.append(key[a + j])
                    if len(us) == 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
                        us, vs = [], []
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            # the last group may go on in the next batch
            names = t.column(0).to_numpy()
            last = int(np.searchsorted(names, names[-1]))
            held = t.slice(last)
            if last:
                yield from pairs(t.slice(0, last))
        if held is not None:
            yield from pairs(held)

    rows = members.select("shingle", "key", "n", "parity", "class").repartition("shingle").sortWithinPartitions("shingle", "key")
    return rows.mapInArrow(run, "u long, v long").distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of (u, v) whose whole sets have a similarity of 0.8 or more; texts: (key, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        last, a = None, np.zeros(0, np.uint64)
        for batch in batches:
            good = []
            for u, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if u != last:
                    last, a = u, shingle_set(unpack.decompress(x.as_buffer()).decode())
                b = shingle_set(unpack.decompress(y.as_buffer()).decode())
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(5 * both >= 4 * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    left, right = texts.toDF("u", "pu"), texts.toDF("v", "pv")
    return pairs.join(right, "v").join(left, "u").select("u", "v", "pu", "pv").mapInArrow(run, "u long, v long")


def _packed_texts(df: DataFrame, text_col: str, keys: DataFrame) -> DataFrame:
    """(key, packed): a compressed text of each of `keys`, which are a written table, so that the join's planner knows their size."""

    def make():
        def work(texts):
            press = zstandard.ZstdCompressor(level=1, write_content_size=True)
            out = {"key": [], "packed": []}
            for _, part in blocks(texts):
                for t in part:
                    out["key"].append(set_key(shingle_set(t)))
                    out["packed"].append(press.compress(t.encode("utf-8", "surrogatepass").decode("utf-8", "replace").encode()))
            return out

        return work

    return map_texts(df, [], text_col, "key long, packed binary", make).join(keys, "key", "left_semi").dropDuplicates(["key"])


def _keys(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()


def _linked(df: DataFrame, text_col: str, sets: DataFrame, shard: int, scratch: Scratch) -> DataFrame:
    """(node, component) over the distinct sets (key, n, fp, parity, prefix): classes of confirmed pairs."""
    # by SimHash: a set of each fingerprint stands for it, and others with the same fingerprint hang on that one
    by_print = sets.groupBy("fp").agg(F.min("key").alias("u"))
    same = sets.select("fp", "key").join(by_print, "fp").where("key > u").select("u", F.col("key").alias("v"))
    links = scratch.durable(fingerprint_links(by_print.select("fp"), shard), "links")
    far = links.join(by_print.select(F.col("fp").alias("u"), F.col("u").alias("a")), "u").join(by_print.select(F.col("fp").alias("v"), F.col("u").alias("b")), "v").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    # by the rarest shingles: those that more than one set has
    flat = sets.select(F.explode("prefix").alias("shingle"), "key").withColumn("rows", F.count("*").over(W.partitionBy("shingle")))
    shared = scratch.durable(flat.where("rows > 1").select("shingle", "key"), "shared")
    members = shared.join(sets.select("key", "n", "parity"), "key")
    first = scratch.durable(same.unionByName(far).unionByName(_group_pairs(members.withColumn("class", F.col("key")), forest)).distinct(), "pairs")
    texts = scratch.durable(_packed_texts(df, text_col, scratch.durable(_keys(first), "wanted")), "texts")
    links = scratch.durable(_confirmed(first, texts), "links")
    classes = scratch.durable(connected_components(links), "classes")
    # what is left are pairs across classes: only shingles that are shared by more than one
    named = shared.join(classes.withColumnRenamed("node", "key"), "key", "left").select("shingle", "key", F.coalesce("component", "key").alias("class"))
    mixed = named.groupBy("shingle").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("shingle")
    members = named.join(mixed, "shingle", "left_semi").join(sets.select("key", "n", "parity"), "key")
    rest = scratch.durable(_group_pairs(members, across).join(first, ["u", "v"], "left_anti"), "pairs")
    if rest.isEmpty():
        return classes
    lacking = scratch.durable(_keys(rest).join(texts.select("key"), "key", "left_anti"), "wanted")
    if not lacking.isEmpty():
        texts = texts.unionByName(scratch.durable(_packed_texts(df, text_col, lacking), "texts"))
    return scratch.durable(connected_components(links.unionByName(_confirmed(rest, texts))), "classes")


def _classed(df: DataFrame, text_col: str, id_col: str, shard: int, scratch: Scratch) -> DataFrame:
    """(id, h1, h2, key, component): each row's id, two hashes of its text, its set, and a key that names its class."""
    tagged = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("h1"), F.xxhash64(F.lit(SEED), F.col(f"`{text_col}`")).alias("h2"), F.col(f"`{text_col}`").alias("text"))
    rows, path = durable_at(prefixes(tagged, "text", ["id", "h1", "h2"]), "prefixes")
    ids = scratch.durable(rows.select("id", "h1", "h2", "key"), "ids")
    sets = scratch.durable(rows.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "fp", "parity", "prefix")]), "sets")
    drop_path(df.sparkSession, path)
    classes = _linked(df, text_col, sets, shard, scratch)
    return ids.join(classes.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))


def near_copies(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", shard: int = SHARD) -> DataFrame:
    """(id, key, component_id) for every row: the smallest id reachable over pairs with a similarity of 0.8 or more.

    Equal sets of shingles have equal keys; null and empty texts are equal. A null id never names a component unless
    nothing else is in it. Rows that repeat an id are rows of their own; an empty table gives an empty one; other columns are not read.
    """
    scratch = Scratch()
    rows = durable(_classed(df, text_col, id_col, shard, scratch), "classed")
    scratch.drop()
    least = rows.groupBy("component").agg(F.min("id").alias("component_id"))
    return rows.join(least, "component").select(F.col("id").alias(id_col), "key", "component_id")


def keep_one(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", shard: int = SHARD) -> DataFrame:
    """df with exactly one row of each class of near copies: that of the smallest id, and of several such rows that of the least hash of its text.

    A row with a null id stays only where no row of its class has an id. Rows are told apart by id and text, not by id alone:
    rows of one id in different classes are judged each for itself; of rows equal in id and text any one stays. The rows are
    shuffled once, by id and hash of the text.
    """
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h1", "h2")).alias("best")
    scratch = Scratch()
    stay = _classed(df, text_col, id_col, shard, scratch).groupBy("component").agg(best).select("best.id", "best.h1", "best.h2")
    columns, text = df.columns, F.col(f"`{text_col}`")
    names = [fresh(name, columns) for name in ("kept_no_id", "kept_id", "kept_h1", "kept_h2")]
    zero = F.lit(0).cast(df.schema[id_col].dataType)  # equal keys without nulls, so that one shuffle serves both steps
    marks = lambda i, h1, h2: [i.isNull().alias(names[0]), F.coalesce(i, zero).alias(names[1]), h1.alias(names[2]), h2.alias(names[3])]
    stay = durable(stay.select(marks(F.col("id"), F.col("h1"), F.col("h2"))), "kept")
    scratch.drop()
    tagged = df.select("*", *marks(F.col(f"`{id_col}`"), F.xxhash64(text), F.xxhash64(F.lit(SEED), text)))
    return tagged.dropDuplicates(names).join(stay, names, "left_semi").select(*quoted(columns))
