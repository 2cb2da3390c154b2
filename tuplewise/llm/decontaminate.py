"""Benchmark decontamination by winnowing, in DataFrame operations alone.

Every text becomes an array of words, and each word a hash. Its k-grams (K words) get hashes from those of their halves, and of each
WINDOW neighbouring k-grams the least hash is kept (minima of one, two and four places, so no window is looked at whole).
K + WINDOW - 1 = SPAN = 13, so what is kept from a span of 13 words depends on that span alone: any 13 words that a document shares
with an item share a kept fingerprint. Fingerprints of both sides are joined, and each hit is extended: a window of 13 words that
holds the k-gram begins at most SPAN - K words before it, so the few words around the hit suffice to compare all such windows with the
item's, word by word. Items of fewer than 13 words are one window; documents give all their spans of those lengths (as many lengths as
the items have, 12 at most).

Shape of the plan: the documents are read once and never shuffled. Each row makes its kept hashes CHUNK words at a time and drops those
that no item can have, by a bitmap of the items' hashes (a constant of MOST_BITS at most); what is left carries the words around it to the
join with the fingerprints. The item side is broadcast if its measured size is at most BROADCAST_BYTES, else both joins shuffle
those few rows. Only hits and one row a document reach the final aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, quoted
from .words import let, span, words_of

SPAN, K = 13, 8
WINDOW = SPAN - K + 1
BROADCAST_BYTES = 64 << 20
#: Words of a document whose hashes are held at once; chunks overlap by SPAN - 1.
CHUNK = 20_000
#: Bits of the bitmap for each of the items' hashes, and bounds of its size.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 12, 1 << 23
#: A k-gram's value: 32 bits of hash above 31 bits of its place (from 1), so that the least one is found with its place.
_PLACE_BITS = 31
_CONTEXT = "struct<h:bigint,start:int,len:int,near:array<string>>"


def _neighbours(values: Column, shift: int, body) -> Column:
    """Array of body(values[i], values[i + shift]), as long as both are there."""
    return let(values, lambda v: F.transform(F.slice(v, 1, F.greatest(F.size(v) - shift, F.lit(0))), lambda x, i: body(x, F.get(v, i + shift))))


def _grams(hashes: Column, n: int) -> Column:
    """Hashes of all spans of n words, from those of single words: a span's hash is that of its two parts' hashes, the first a power of two long."""
    if n == 1:
        return hashes
    first = 1 << ((n - 1).bit_length() - 1)
    if 2 * first == n:
        return _neighbours(_grams(hashes, first), first, lambda a, b: F.xxhash64(a, b))
    return F.zip_with(F.slice(_grams(hashes, first), 1, F.greatest(F.size(hashes) - n + 1, F.lit(0))), F.slice(_grams(hashes, n - first), first + 1, F.greatest(F.size(hashes) - n + 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _short(h: Column) -> Column:
    return h.bitwiseAND(F.lit(0xFFFFFFFF))


def _kept(hashes: Column) -> Column:
    """Winnowed k-grams of an array of word hashes, as hash << 31 | place; none for fewer than SPAN words."""
    placed = F.transform(_grams(hashes, K), lambda h, i: F.shiftleft(_short(h), _PLACE_BITS).bitwiseOR((i + 1).cast("long")))
    two = _neighbours(placed, 1, lambda a, b: F.least(a, b))
    four = _neighbours(two, 2, lambda a, b: F.least(a, b))
    return F.array_distinct(_neighbours(four, WINDOW - 4, lambda a, b: F.least(a, b)))


def _place(kept: Column) -> Column:
    return kept.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int")


def _windows(words: Column, length: int) -> Column:
    return span(F.size(words) - (length - 1), lambda i: F.array_join(F.slice(words, i, length), " "), "string")


def item_windows(items: DataFrame, text_col: str = "text", id_col: str = "item_id") -> DataFrame:
    """(win, items): each distinct window of the items, its words joined by spaces, with the sorted ids of its items."""
    words = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    wins = F.when(F.size("w") >= SPAN, _windows(F.col("w"), SPAN)).otherwise(F.array(F.array_join("w", " ")))
    return words.select("item_id", F.explode(wins).alias("win")).groupBy("win").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def item_fingerprints(items: DataFrame, text_col: str = "text") -> DataFrame:
    """(h): distinct hashes of the items' kept k-grams, or of a short item's words."""
    words = items.select(words_of(F.col(text_col)).alias("w")).where("size(w) > 0").distinct()
    kept = F.when(F.size("w") >= SPAN, F.transform(_kept(_hashes(F.col("w"))), lambda x: F.shiftright(x, _PLACE_BITS)))
    for n in range(1, SPAN):
        kept = kept.when(F.size("w") == n, F.transform(_grams(_hashes(F.col("w")), n), _short))
    return words.select(F.explode(kept).alias("h")).distinct()


def _bitmap(prints: DataFrame, n: int) -> Column:
    """The bits of all hashes, folded, as a constant array of 64-bit numbers; its size goes by n, up to a bound, beyond which it only lets more pass."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * n).bit_length()))
    cell = F.shiftright("h", 6).bitwiseAND(F.lit(bits // 64 - 1)).cast("int")
    rows = prints.groupBy(cell.alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 AS int))")).alias("v")).collect()  # at most MOST_BITS / 64
    cells = [0] * (bits // 64)
    for r in rows:
        cells[r["cell"]] = r["v"]
    return F.split(F.lit(",".join(map(str, cells))), ",").cast("array<bigint>")  # folded to a constant by the optimizer


def _possible(h: Column, bitmap: Column, cells: int) -> Column:
    return F.bit_get(F.get(bitmap, F.shiftright(h, 6).bitwiseAND(F.lit(cells - 1)).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def _contexts(words: Column, short: list[int], possible) -> Column:
    """Possible hits with the words around them: kept k-grams, and all spans of the lengths in `short`."""
    reach = SPAN - K

    def chunk(w: Column, before: Column) -> Column:
        def parts(hashes: Column) -> Column:
            def around(x: Column) -> Column:
                start = F.greatest(_place(x) - reach, F.lit(1))
                return F.struct(F.shiftright(x, _PLACE_BITS).alias("h"), (before + start).alias("start"), F.lit(SPAN).alias("len"), F.slice(w, start, _place(x) + K + reach - start).alias("near"))

            def spot(n: int):
                return lambda x: F.struct(x["h"].alias("h"), (before + x["i"]).alias("start"), F.lit(n).alias("len"), F.slice(w, x["i"], n).alias("near"))

            out = [F.transform(F.filter(_kept(hashes), lambda x: possible(F.shiftright(x, _PLACE_BITS))), around)]
            for n in short:
                placed = F.transform(_grams(hashes, n), lambda h, i: F.struct(_short(h).alias("h"), (i + 1).alias("i")))
                out.append(F.transform(F.filter(placed, lambda x: possible(x["h"])), spot(n)))
            return F.concat(*[p.cast(f"array<{_CONTEXT}>") for p in out])

        return let(_hashes(w), parts)

    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(CHUNK))
    return F.flatten(F.transform(starts, lambda s: let(F.slice(words, s + 1, CHUNK + SPAN - 1), lambda w: chunk(w, s))))


def _judged(docs: DataFrame, items: DataFrame, carry: dict[str, Column], text: Column, item_text: str, item_id: str, broadcast_bytes: int) -> DataFrame:
    """contamination() behind the columns of `carry`, which are of a row of docs."""
    wins = durable(item_windows(items, item_text, item_id), "windows")
    prints = durable(item_fingerprints(items, item_text), "prints")
    size = wins.agg(F.sum(F.length("win") + 8 * F.size("items") + 64)).first()[0] or 0
    short = sorted(r[0] for r in items.select(F.size(words_of(F.col(item_text))).alias("n")).where(f"n > 0 and n < {SPAN}").distinct().collect())  # lengths: 12 at most
    n = prints.count()
    hint = F.broadcast if size + 32 * n <= broadcast_bytes else (lambda x: x)
    bits = _bitmap(prints, n)
    cells = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * n).bit_length())) // 64
    possible = lambda h: _possible(h, bits, cells)

    # the first entry is the document's own, with a hash that no k-gram has, spread so that it makes no hot key
    rows = docs.select(*[c.alias(k) for k, c in carry.items()], F.monotonically_increasing_id().alias("row"), text.alias("t"))
    own = lambda n: F.struct((-1 - F.col("row") % 4096).alias("h"), n.alias("start"), F.lit(0).alias("len"), F.array().cast("array<string>").alias("near")).cast(_CONTEXT)
    entries = let(words_of(F.col("t")), lambda w: F.concat(F.array(own(F.size(w))), _contexts(w, short, possible)))
    found = rows.select(*carry, "row", F.inline(entries)).join(hint(prints.select("h", F.lit(True).alias("seen"))), "h", "left").where("len = 0 or seen")
    # of each hit, all windows that hold it; a document's own entry goes along under a name that is no window
    pick = F.when(F.col("len") == 0, F.array(F.struct(F.col("start").alias("start"), F.concat(F.lit("|"), (F.col("row") % 4096).cast("string")).alias("win")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size("near") - F.col("len")), lambda s: F.struct((F.col("start") + s).alias("start"), F.array_join(F.slice("near", s + 1, F.col("len")), " ").alias("win")))
    )
    candidates = found.where("size(near) >= len").select(*carry, "row", "len", F.inline(pick))
    hits = candidates.join(hint(wins.select("win", "items")), "win", "left").where("len = 0 or items is not null")
    by_doc = hits.groupBy("row", *carry).agg(
        F.max(F.when(F.col("len") == 0, F.col("start"))).cast("long").alias("n_words"),
        F.collect_set(F.when(F.col("len") > 0, F.struct("start", "len"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    places = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))
    out = by_doc.select(*carry, "n_words", F.size(places).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs.

    A null or wordless document has no words and is clean; null or wordless items have no window; repeated items
    count by their ids (a null id names no item); repeated or null document ids are rows of their own. An empty item table leaves every document clean.
    Columns of either table besides id and text are not read.
    """
    return _judged(docs, items, {"id": F.col(id_col)}, F.col(text_col), item_text, item_id, broadcast_bytes).withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text is contaminated.

    Each row is judged by its own text (told by two 64-bit hashes), so null and repeated ids don't matter, and columns of any name stay. Null and
    empty texts stay; an empty table stays one. The hashes of contaminated texts are written first, so Spark knows whether they are few enough to broadcast.
    """
    text = F.col(f"`{text_col}`")
    marks = {fresh("text_h1", docs.columns): F.xxhash64(text), fresh("text_h2", docs.columns): F.xxhash64(F.lit(SPAN), text)}
    bad = durable(_judged(docs, items, marks, text, "text", "item_id", BROADCAST_BYTES).where("contaminated").select(*marks).distinct(), "contaminated")
    return docs.select("*", *[c.alias(k) for k, c in marks.items()]).join(bad, list(marks), "left_anti").select(*quoted(docs.columns))


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
       FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, n WHERE len(w) >= n)),
hit AS (SELECT DISTINCT dw.r, dw.s, dw.n, bw.item_id FROM dw JOIN bw USING (win)),
placed AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM (SELECT DISTINCT r, s, n FROM hit)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN placed USING (r) LEFT JOIN named USING (r)
"""
