"""SimHash near-duplicates with BK-trees.

A fingerprint has a bit for each of 64 places: 1 if more than half of the text's 3-word shingles have it
in their XXH64. Fingerprints that differ in at most RADIUS = 2 bits are linked.

Search. The distinct fingerprints are dealt to shards of about SHARD / 2, and every shard has one BK-tree that holds all its fingerprints:
children stand under the integer Hamming distance to their parent, and each fingerprint of the shard is looked up by the edges d-2..d+2
alone. Three tables of shards lose no link: cut 64 bits into three blocks, and two differing bits leave at least one whole; the
shards of a table are told apart by the first bits of its block, as many as the number of fingerprints asks for.
A shard with more than SHARD fingerprints is dealt again by further bits of its block, and once that is used up by three blocks
of the bits that are left; with no bit left a shard holds one fingerprint, so this ends.

Trees are built where the shard's rows are, and go nowhere else. To broadcast them, as a single index in memory would, all
fingerprints would have to pass the driver, and every tree would be asked by every fingerprint: the square of the corpus. Inside
a shard a union-find keeps the links that join two classes, so a shard of n fingerprints yields n-1 links at most and never all pairs.

Copies are folded before any of this (one row for each distinct fingerprint), and counts by shard are
pre-aggregated, so hot texts or shards don't meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, durable, map_texts, ship_package
from .components import connected_components

RADIUS, BITS, SHARD, SEED = 2, 64, 1024, 42
#: Bits by which a shard that is too large is dealt again.
STEP = 4


def shingle_fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint (unsigned); no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) >= 3 else [b" ".join(words)]
    return fingerprint_of(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))))


def fingerprint_of(digests: bytes) -> int:
    """The fingerprint of shingles, given as 8 bytes (big-endian) each."""
    n = len(digests) // 8
    raw = np.frombuffer(digests, np.uint8).reshape(n, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(raw[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fp long): fingerprints as signed 64-bit integers. Null and empty texts: 0."""

    def make():
        def work(texts):
            return {"fp": [signed(shingle_fingerprint(t)) for _, part in blocks(texts) for t in part]}

        return work

    return map_texts(df, [id_col], text_col, "fp long", make)


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Place a value (one already there is not placed again) and return its node."""
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return 0
        at = 0
        while True:
            d = (self.values[at] ^ value).bit_count()
            if d == 0:
                return at
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return len(self.values) - 1
            at = nxt

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Nodes at distance `radius` or less."""
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            children = self.children[at]
            for e in range(d - radius, d + radius + 1):
                if e in children:
                    stack.append(children[e])


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (positions in `values`) that join classes of a shard: at most len(values) - 1."""
    tree, root, out = BKTree(), list(range(len(values))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    where: list[int] = []
    for i, value in enumerate(values):
        for node in tree.within(value, radius):
            j = where[node]
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                out.append((j, i))
        if tree.add(value) == len(where):
            where.append(i)
    return out


def _spread(bits: list[int], parts: int) -> list[list[int]]:
    edges = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:], strict=False)]


@dataclass(frozen=True)
class Cut:
    """A table of shards: those of equal bits under `mask`. `block`: further bits that two linked fingerprints of the table share; `free`: all others not in the mask."""

    mask: int
    block: tuple[int, ...]
    free: tuple[int, ...]

    def deeper(self, bits: int) -> Cut:
        return Cut(self.mask | sum(1 << b for b in self.block[:bits]), self.block[bits:], self.free)

    def parts(self) -> list[Cut]:
        """Tables that part the shards of this one further and keep every link of RADIUS bits in at least one."""
        if self.block:
            return [self.deeper(STEP)]
        return [Cut(self.mask, tuple(part), tuple(b for b in self.free if b not in part)).deeper(STEP) for part in _spread(list(self.free), RADIUS + 1) if part]


def first_cuts(n: int, shard: int) -> list[Cut]:
    """Tables for n fingerprints: one of a single shard if that is enough, else one a block, with about half a shard in each."""
    everything = Cut(0, (), tuple(range(BITS)))
    if n <= shard:
        return [everything]
    bits = max(1, (2 * n // shard - 1).bit_length())
    return [Cut(0, tuple(part), tuple(b for b in range(BITS) if b not in part)).deeper(bits) for part in _spread(list(range(BITS)), RADIUS + 1)]


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (cut, value, fp) with the rows of a shard together: the links of each shard, by its tree."""
    key, group = None, []
    us: list[int] = []
    vs: list[int] = []

    def close():
        if len(group) > 1:
            for i, j in shard_links([x & 0xFFFFFFFFFFFFFFFF for x in group]):
                us.append(group[i])
                vs.append(group[j])

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
        us.clear()
        vs.clear()
        return out

    for batch in batches:
        for cut, value, fp in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (cut, value) != key:
                close()
                key, group = (cut, value), []
            group.append(fp)
        if us:
            yield flush()
    close()
    yield flush()


def fingerprint_links(distinct: DataFrame, shard: int = SHARD) -> DataFrame:
    """(u, v): links between the fingerprints of `distinct` (fp long, no repeats) that keep every class whole."""
    ship_package(distinct.sparkSession)
    cuts = dict(enumerate(first_cuts(distinct.count(), shard)))
    rows = distinct.select("fp", F.explode(F.array(*map(F.lit, cuts))).alias("cut"))
    out = None
    while True:
        mask = F.create_map(*[x for k, c in cuts.items() for x in (F.lit(k), F.lit(signed(c.mask)))])
        rows = rows.select("cut", mask[F.col("cut")].bitwiseAND(F.col("fp")).alias("value"), "fp")
        sizes = rows.groupBy("cut", "value").agg(F.count("*").alias("n"))
        large = sizes.where(F.col("n") > shard).select("cut", "value")
        if large.isEmpty():
            large = None
        else:
            large = durable(large, "large")  # a row a shard that is dealt again
        ready = rows if large is None else rows.join(large, ["cut", "value"], "left_anti")
        links = ready.repartition("cut", "value").sortWithinPartitions("cut", "value", "fp").mapInArrow(_link_groups, "u long, v long")
        out = links if out is None else out.unionByName(links)
        if large is None:
            return out
        again = durable(rows.join(large, ["cut", "value"], "left_semi").select("cut", "fp"), "again")
        finer, into = {}, []
        for k, c in cuts.items():
            names = []
            for part in c.parts():
                names.append(len(finer))
                finer[len(finer)] = part
            into += [F.lit(k), F.array(*map(F.lit, names))]
        cuts = finer
        rows = again.select("fp", F.explode(F.create_map(*into)[F.col("cut")]).alias("cut"))


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", shard: int = SHARD) -> DataFrame:
    """(id, fingerprint, component_id) for every row: the smallest id reachable over links of at most two bits.

    Null or empty texts have fingerprint zero and are linked like any other. Rows that repeat an id are rows
    of their own. A null id is kept, and never names a component unless nothing else is in it. An empty table
    gives an empty one. Other columns of df, whatever their names, are not read.
    """
    scratch = Scratch()
    rows = durable(fingerprints(df, text_col, id_col).withColumnRenamed(id_col, "id"), "fingerprints")
    distinct = scratch.durable(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    classes = connected_components(fingerprint_links(distinct.select("fp"), shard))
    linked = distinct.join(classes, distinct.fp == classes.node).select("fp", "first", "component")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    linked = linked.join(least, "component").select(F.col("fp").alias("linked_fp"), "least")
    named = durable(distinct.join(linked, F.col("fp") == F.col("linked_fp"), "left").select("fp", F.coalesce("least", "first").alias("component_id")), "named")
    scratch.drop()
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
