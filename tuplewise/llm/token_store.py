"""A content-addressed store of token ids.

Files (all Parquet, so that any store that Spark reaches will do):

* `chunks`: (chunk_id, n, data) - a rolling hash over WINDOW ids cuts each document's id stream where its top
  bits are zero, so equal passages cut alike wherever they stand; each unique chunk is stored once, under the
  SHA-256 of its ids as little-endian unsigned 32-bit integers; data is zstd over 16-bit ids (32-bit ones
  for vocabularies over 65,536).
* `recipes`: (shard, doc_id, seq, n_tokens, root, chunk_ids, lengths), in ascending order of doc_id: shards are
  ranges of doc_id, each sorted. root is the Merkle root of the document's chunks.
* `manifest`: (shard, n_docs, n_tokens, start, root): ids before the shard, and the Merkle root of its documents' roots.

Readers check what they read: a chunk against its address, a recipe against its root, a shard against the
manifest. Checksums of documents are put together from those of their chunks (CRC-32 is linear), so a chunk that
many documents share is read once and no document's ids have to meet in one place.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLOCK_CHARS, blocks, drop_path, durable_at, map_texts, new_path, ship_package
from .pieces import PieceEncoder

WINDOW, LEAST, MOST, CUT_BITS = 16, 256, 4096, 10
END_ID = 0


class CorruptStore(ValueError):
    """What was read doesn't match its address, root or manifest."""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class TokenEncoder:
    """The tokenizers library, as its plain call encodes, behind a bounded table of words."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        # only there does a match begin at each single space; elsewhere whole texts go to the library
        self.by_piece = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        added = [t["content"] for t in spec.get("added_tokens") or [] if t["content"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.pieces = PieceEncoder(self._encode, self._encode_words)
        # each character of a token's string stands for a byte
        vocab = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Many words, a space before each, in one text for the library; its tokens' lengths tell where each one ends."""
        runs = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, len(words), 500), len(words)), pa.int32()), words)
        ids = np.frombuffer(b"".join(self._encode([" " + run for run in pc.binary_join(runs, " ").to_pylist()])), "<u4")
        ends = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)
        at = np.cumsum(self.bytes_of[ids])
        stops = np.searchsorted(at, ends)
        if not np.array_equal(at[stops], ends):
            raise ValueError("a token spans two words: the tokenizer doesn't split before spaces")
        return ids, np.diff(stops + 1, prepend=0)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return self._encode(texts)
        if self.added is None:
            return self.pieces.encode(texts)
        # the library finds added tokens in a text before it splits, so a text that holds one goes there whole
        whole = {i: t for i, t in enumerate(texts) if self.added.search(t)}
        out = self.pieces.encode(["" if i in whole else t for i, t in enumerate(texts)])
        for i, x in zip(whole, self._encode(list(whole.values())), strict=True):
            out[i] = x
        return out


_encoders: dict[str, TokenEncoder] = {}


def encoder(path: str) -> TokenEncoder:
    if path not in _encoders:
        _encoders[path] = TokenEncoder(path)
    return _encoders[path]


def gear_table(size: int) -> np.ndarray:
    """A fixed random 64-bit number for each id."""
    return np.random.Generator(np.random.PCG64(20240917)).integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def rolling_hash(ids: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """At each place, a hash of the last WINDOW ids (fewer near the start): sums of gear values, doubled a step, mod 2^64."""
    h = gear[ids]
    width = 1
    while width < WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint64(width))
        width *= 2
    return h


def candidate_cuts(ids: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """Places behind which a chunk may end: where the rolling hash's top bits are zero."""
    return np.flatnonzero(rolling_hash(ids, gear) >> np.uint64(64 - CUT_BITS) == 0) + 1


def cuts_between(places: list[int], n: int) -> list[int]:
    """Ends of the chunks of a document of n ids, from the candidate places in it."""
    ends, last = [], 0
    for p in [*places, n]:
        while p - last > MOST:
            last += MOST
            ends.append(last)
        if p - last >= LEAST and p < n:
            ends.append(p)
            last = p
    if last < n:
        ends.append(n)
    return ends


def cut_points(ids: np.ndarray, gear: np.ndarray) -> list[int]:
    """Ends of the chunks of one document's ids."""
    return cuts_between(candidate_cuts(ids, gear).tolist(), len(ids))


def cut_block(raws: list[bytes], gear: np.ndarray) -> list[list[int]]:
    """cut_points() of many documents, hashed in one go: no chunk ends in the first LEAST ids, where a hash would reach into the document before."""
    sizes = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
    places = candidate_cuts(np.frombuffer(b"".join(raws), "<u4"), gear)
    starts = np.cumsum(sizes) - sizes
    at = np.searchsorted(places, np.append(starts, starts[-1:] + sizes[-1:]), side="right").tolist()
    return [cuts_between((places[a:b] - start).tolist() if b > a else [], n) for a, b, start, n in zip(at, at[1:], starts.tolist(), sizes.tolist(), strict=False)]


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; leaves and inner nodes are hashed under different prefixes, an odd one moves up."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


def pack(ids: np.ndarray, width: int, press: zstandard.ZstdCompressor) -> bytes:
    return bytes([width]) + press.compress(ids.astype(f"<u{width}").tobytes())


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    return np.frombuffer(zstandard.decompress(data[1:], max_output_size=MOST * width), f"<u{width}").astype("<u4")


def cut_documents(df: DataFrame, text_col: str, id_col: str, tokenizer: str) -> DataFrame:
    def make():
        enc = encoder(tokenizer)
        gear, width, press = gear_table(max(enc.size, 1)), 2 if enc.size <= 1 << 16 else 4, zstandard.ZstdCompressor(level=3, write_content_size=True)
        end = np.array([END_ID], "<u4").tobytes()

        def work(texts):
            out = {"n_tokens": [], "root": [], "chunk_ids": [], "lengths": [], "chunks": []}
            for _, part in blocks(texts, 4 * BLOCK_CHARS):
                raws = [raw + end for raw in enc.encode(part)]
                for raw, ends in zip(raws, cut_block(raws, gear), strict=True):
                    ids = np.frombuffer(raw, "<u4")
                    cuts = list(zip([0, *ends], ends, strict=False))
                    names = [hashlib.sha256(raw[4 * a : 4 * b]).digest() for a, b in cuts]
                    out["n_tokens"].append(len(ids))
                    out["root"].append(merkle_root(names))
                    out["chunk_ids"].append(names)
                    out["lengths"].append([b - a for a, b in cuts])
                    out["chunks"].append([pack(ids[a:b], width, press) for a, b in cuts])
            return out

        return work

    return map_texts(df, [id_col], text_col, "n_tokens long, root binary, chunk_ids array<binary>, lengths array<int>, chunks array<binary>", make)


def write_store(df: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", tokenizer: str | None = None) -> None:
    """Encode every whole text of df, append END_ID to each, and write the store to `path`. Null texts are empty ones: one id.

    Texts are encoded once; only ids move: unique chunks by address, recipes by range of doc_id. Rows with a null id come
    first. Repeated ids are rows of their own, in an order fixed by their content.
    """
    cut, staging = durable_at(cut_documents(df, text_col, id_col, tokenizer or default_tokenizer()).withColumnRenamed(id_col, "doc_id"), "cut-ids")
    entry = F.explode(F.arrays_zip("chunk_ids", "lengths", "chunks"))
    flat = cut.select(entry.alias("e")).select(F.col("e.chunk_ids").alias("chunk_id"), F.col("e.lengths").alias("n"), F.col("e.chunks").alias("data"))
    flat.groupBy("chunk_id").agg(F.first("n").alias("n"), F.first("data").alias("data")).write.option("compression", "none").parquet(f"{path}/chunks")
    recipes = cut.select("doc_id", "n_tokens", "root", "chunk_ids", "lengths").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "root")
    recipes.select(F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().alias("seq"), "*").write.option("compression", "zstd").parquet(f"{path}/recipes")
    drop_path(df.sparkSession, staging)
    shards = _shard_roots(df.sparkSession.read.parquet(f"{path}/recipes"))
    starts = F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))  # a row a shard
    shards.withColumn("start", F.coalesce(starts, F.lit(0))).coalesce(1).write.parquet(f"{path}/manifest")


def _shard_roots(recipes: DataFrame) -> DataFrame:
    ship_package(recipes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {"shard": [], "n_docs": [], "n_tokens": [], "root": []}
        key, roots, total = None, [], 0

        def close():
            if key is not None:
                for name, value in zip(out, (key, len(roots), total, merkle_root(roots)), strict=True):
                    out[name].append(value)

        for batch in batches:
            for shard, n, root in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if shard != key:
                    close()
                    key, roots, total = shard, [], 0
                roots.append(root)
                total += n
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out["shard"], pa.int32()), pa.array(out["n_docs"], pa.int64()), pa.array(out["n_tokens"], pa.int64()), pa.array(out["root"], pa.binary())], names=list(out))

    ordered = recipes.select("shard", "seq", "n_tokens", "root").repartition("shard").sortWithinPartitions("shard", "seq")
    return ordered.select("shard", "n_tokens", "root").mapInArrow(run, "shard int, n_docs long, n_tokens long, root binary")


def _matrices() -> np.ndarray:
    """For each k, what 2^k zero bytes behind a message do to its CRC-32: 32 columns."""
    one = np.zeros(32, np.uint32)
    one[0] = 0xEDB88320
    one[1:] = np.uint32(1) << np.arange(31, dtype=np.uint32)

    def square(m: np.ndarray) -> np.ndarray:
        return _times(m, m)

    m = square(square(square(one)))
    out = [m]
    for _ in range(40):
        out.append(m := square(m))
    return np.array(out)


def _times(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0)).astype(np.uint32)
    return out


_SHIFT = _matrices()


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """A message's CRC-32's share in that of the message and n_bytes more behind it; shares are joined by xor."""
    crc, n = crc.astype(np.uint32).copy(), n_bytes.astype(np.int64)
    for k in range(int(n.max()).bit_length() if n.size else 0):
        some = np.flatnonzero(n >> k & 1)
        crc[some] = _times(_SHIFT[k], crc[some])
    return crc


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, n, crc): every stored chunk, unpacked and checked against its address."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for name, n, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = unpack(data).tobytes()
                if hashlib.sha256(raw).digest() != name or len(raw) != 4 * n:
                    raise CorruptStore(f"chunk {name.hex()}")
                crcs.append(zlib.crc32(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], names=["chunk_id", "n", "crc"])

    return spark.read.parquet(f"{path}/chunks").select("chunk_id", "n", "data").mapInArrow(run, "chunk_id binary, n int, crc long")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """(shard, doc_id, seq, start, n_tokens, entries of (chunk_id, place, n, after)): recipes checked against their roots and the manifest.

    `start`: ids of all documents before; `place`, `n`, `after`: ids of the document before, in and behind a chunk.
    """
    ship_package(spark)
    check_shards(spark, path)
    recipes = spark.read.parquet(f"{path}/recipes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = []
            for root, names, lengths, n in zip(*(batch.column(i).to_pylist() for i in range(4, 8)), strict=True):
                if merkle_root(names) != root or sum(lengths) != n:
                    raise CorruptStore("a document's recipe")
                place, out = 0, []
                for name, k in zip(names, lengths, strict=True):
                    out.append({"chunk_id": name, "place": place, "n": k, "after": n - place - k})
                    place += k
                entries.append(out)
            kind = pa.list_(pa.struct([("chunk_id", pa.binary()), ("place", pa.int64()), ("n", pa.int32()), ("after", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(entries, kind)], names=["shard", "doc_id", "seq", "n_tokens", "entries"])

    opened = recipes.select("shard", "doc_id", "seq", "n_tokens", "root", "chunk_ids", "lengths", F.col("n_tokens").alias("n")).mapInArrow(run, "shard int, doc_id long, seq long, n_tokens long, entries array<struct<chunk_id: binary, place: long, n: int, after: long>>")
    before = F.sum("n_tokens").over(W.partitionBy("shard").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    manifest = spark.read.parquet(f"{path}/manifest").select("shard", F.col("start").alias("shard_start"))
    return opened.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(manifest), "shard").withColumn("start", F.col("shard_start") + F.col("before")).drop("before", "shard_start")


def check_shards(spark: SparkSession, path: str) -> tuple[int, int]:
    """Compare the manifest's shards with those of the recipes, at once; returns (documents, ids) or raises CorruptStore."""
    starts = F.coalesce(F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a shard
    found = _shard_roots(spark.read.parquet(f"{path}/recipes")).select("shard", F.struct("n_docs", "n_tokens", starts.alias("start"), "root").alias("found"))
    told = spark.read.parquet(f"{path}/manifest").select("shard", F.struct("n_docs", "n_tokens", "start", "root").alias("told"))
    same = F.col("told").eqNullSafe(F.col("found"))
    bad, docs, ids = told.join(found, "shard", "full").agg(F.count_if(~same), F.sum("told.n_docs"), F.sum("told.n_tokens")).first()
    if bad:
        raise CorruptStore(f"{bad} shards differ from the manifest")
    return docs or 0, ids or 0


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    recipes = read_recipes(spark, path).select("doc_id", "seq", "start", "n_tokens", F.explode("entries").alias("e")).select("doc_id", "seq", "start", "n_tokens", "e.chunk_id", "e.n", "e.after")
    joined = recipes.join(read_chunks(spark, path).select("chunk_id", F.col("n").alias("stored"), "crc"), "chunk_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, after = batch.column(4), batch.column(5).to_numpy()
            if crc.null_count:
                raise CorruptStore("a recipe names a chunk that isn't there")
            if not batch.column(6).equals(batch.column(7)):
                raise CorruptStore("a recipe's length isn't the chunk's")
            share = crc_shift(crc.to_numpy(), 4 * after).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(share)], names=["doc_id", "seq", "start", "n_tokens", "share"])

    shares = joined.select("doc_id", "seq", "start", "n_tokens", "crc", "after", "n", "stored").mapInArrow(run, "doc_id long, seq long, start long, n_tokens long, share long")
    return shares.groupBy("seq").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.first("n_tokens").alias("n_tokens"), F.bit_xor("share").alias("ids_crc32")).drop("seq")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, seq, ids): every document's ids, put together from its chunks; a document's chunks meet in one task."""
    ship_package(spark)
    recipes = read_recipes(spark, path).select("doc_id", "seq", F.explode("entries").alias("e"))
    chunks = spark.read.parquet(f"{path}/chunks").select("chunk_id", "data")
    parts = recipes.select("doc_id", "seq", "e.chunk_id", F.col("e.place").alias("place")).join(chunks, "chunk_id", "left")
    whole = parts.groupBy("seq").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("place", "data"))).alias("parts"))

    def run(batches):
        for batch in batches:
            ids = [np.concatenate([unpack(p["data"]) for p in parts]).tolist() for parts in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "seq", "ids"])

    return whole.select("doc_id", "seq", "parts").mapInArrow(run, "doc_id long, seq long, ids array<long>")


def verify_store(spark: SparkSession, path: str) -> tuple[int, int]:
    """Check every chunk, recipe and shard; returns (documents, ids) or raises CorruptStore."""
    found = check_shards(spark, path)
    read_digests(spark, path).write.format("noop").mode("overwrite").save()
    read_chunks(spark, path).write.format("noop").mode("overwrite").save()
    return found


def token_store_digests(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write df's texts to a store (by default in the shared folder) and read the digests of all documents from it."""
    spark = df.sparkSession
    path = path or new_path(spark, "token-store")
    write_store(df, path, text_col, id_col, tokenizer)
    return read_digests(spark, path).withColumnRenamed("doc_id", id_col)
