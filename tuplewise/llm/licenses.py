"""License scans with a positional index of rare words, in DataFrame operations alone.

Templates are licence notices as files carry them (license_texts.py), short licence lines, and the base phrases. The index has a posting
(word, template, place) for every word; a word's IDF over all templates says how rare it is. For each file and template the RARE highest-IDF
words of the template's mandatory phrases are looked up: where such a word stands at place p of the file and at place q of the template, the
template may begin at p - q. Postings of a template are intersected by that relative position: a start counts if all the template's rare words
agree on it. Then the mandatory key phrases are compared word by word, each at its own place; other words may differ, and the score tells how many don't.

Everything about one file happens inside its row (arrays and their functions): nothing is exploded, joined or
shuffled, so neither hot words nor long or repeated files meet anywhere. The index is a constant of a few kilobytes.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import NOTICES
from .words import let, words_of

RARE = 2


@dataclass(frozen=True)
class Template:
    """A license line: its words in order, its label, and the spans (first word, words) that have to stand verbatim.

    `base` marks the phrases whose places are counted.
    """

    label: str
    text: str
    keys: tuple[tuple[int, int], ...] = ()
    base: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall("[a-z0-9]+", self.text.lower())

    @property
    def spans(self) -> tuple[tuple[int, int], ...]:
        return self.keys or ((0, len(self.words)),)

    @property
    def key_words(self) -> list[tuple[int, str]]:
        words = self.words
        return sorted({(i, words[i]) for first, n in self.spans for i in range(first, first + n)})


def notice(label: str, text: str, phrases: tuple[str, ...]) -> Template:
    """A template of a whole notice; its mandatory phrases are found in it."""
    words = Template(label, text).words
    spans = []
    for phrase in phrases:
        wanted = phrase.split()
        spans.append((next(i for i in range(len(words)) if words[i : i + len(wanted)] == wanted), len(wanted)))
    return Template(label, text, tuple(spans))


#: The base phrases and their labels.
BASE = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
)
#: Short license lines; key spans are what must stand verbatim, other words may differ.
MORE = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ((3, 5),)),
    Template("mit", "released under the mit license", ((2, 3),)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", ((0, 7),)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification", ((0, 8),)),
    Template("cc-by-nc", "licensed under cc by nc", ((2, 3),)),
    Template("cc-by-sa", "licensed under cc by sa", ((2, 3),)),
    Template("cc-by-nd", "licensed under cc by nd", ((2, 3),)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ((3, 6),)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ((3, 6),)),
    Template("lgpl", "licensed under the gnu lesser general public license", ((3, 5),)),
    Template("agpl", "licensed under the gnu affero general public license", ((3, 5),)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ((6, 6),)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ((2, 4),)),
    Template("copyright", "copyright c all rights reserved", ((0, 2),)),
)
TEMPLATES = BASE + MORE + tuple(notice(*n) for n in NOTICES)


def idf(templates: tuple[Template, ...]) -> dict[str, float]:
    """log(templates / templates with the word)."""
    words = {w for t in templates for w in t.words}
    return {w: math.log(len(templates) / sum(w in t.words for t in templates)) for w in words}


def postings(templates: tuple[Template, ...], rare: int = RARE) -> list[list[tuple[str, int]]]:
    """For each template, the (word, place) of its rarest key words: highest IDF first, then first place, one place a word."""
    weight = idf(templates)
    out = []
    for t in templates:
        first: dict[str, int] = {}
        for place, word in t.key_words:
            first.setdefault(word, place)
        out.append(sorted(first.items(), key=lambda x: (-weight[x[0]], x[1]))[:rare])
    return out


def _of(places: Column, word: str, offset: int) -> Column:
    """Starts that the places of a rare word propose."""
    return F.transform(F.filter(places, lambda p: p["w"] == word), lambda p: p["i"] - offset)


def _starts(words: Column, places: Column, template: Template, rare: list[tuple[str, int]]) -> Column:
    """Starts (from 0) of a template in an array of words; places: where rare words stand."""
    proposed = _of(places, *rare[0])
    for posting in rare[1:]:
        proposed = F.array_intersect(proposed, _of(places, *posting))

    def verified(s: Column) -> Column:
        ok = s >= -min(i for i, _ in template.spans)
        for i, n in template.spans:
            ok = ok & (F.slice(words, F.greatest(s + i, F.lit(0)) + 1, n) == _constant(template.words[i : i + n]))
        return F.coalesce(ok, F.lit(False))

    return F.filter(proposed, verified)


def _constant(words: list[str]) -> Column:
    return F.split(F.lit(" ".join(words)), " ")  # folded to a constant by the optimizer


def license_scan(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", templates: tuple[Template, ...] = TEMPLATES, rare: int = RARE) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) for every row of df.

    n_base: places of base phrases, overlapping ones too; first_word, last_word: the least and greatest of them, else null;
    labels: of all templates found, distinct, sorted, comma-joined; score: the greatest share of a found template's
    words that stand at their places (0: none found); matches: (label, start) of all. Null and wordless texts have none: n_words and n_base
    0, empty labels, null places. Where templates tie, each counts, and equal labels are named once. Repeated rows and ids give a row each; an empty
    table an empty one; columns besides id and text are not read, whatever their names.
    """
    index = postings(templates, rare)
    lexicon = sorted({w for p in index for w, _ in p})

    def scan(w: Column) -> Column:
        spotted = F.filter(F.transform(w, lambda x, i: F.when(x.isin(lexicon), F.struct(x.alias("w"), i.alias("i")))), lambda p: p.isNotNull())

        def looked_up(places: Column) -> Column:
            found = []
            for t, rarest in zip(templates, index, strict=True):
                found.append(_labelled(w, _starts(w, places, t, rarest), t))
            return F.concat(*found)

        none = F.array().cast("array<struct<label:string,start:int,base:boolean,share:double>>")
        return F.struct(F.size(w).alias("n"), let(spotted, lambda places: F.when(F.size(places) == 0, none).otherwise(looked_up(places))).alias("m"))

    rows = df.select(F.col(id_col), let(words_of(F.col(text_col)), scan).alias("s")).select(id_col, "s.n", "s.m")
    base = F.transform(F.filter("m", lambda x: x["base"]), lambda x: x["start"])
    names = lambda m: F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))), ",")
    return rows.select(
        id_col,
        F.col("n").cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base).cast("long").alias("first_word"),
        F.array_max(base).cast("long").alias("last_word"),
        names(F.filter("m", lambda x: x["base"])).alias("base_labels"),
        names(F.col("m")).alias("labels"),
        F.coalesce(F.array_max(F.transform("m", lambda x: x["share"])), F.lit(0.0)).alias("score"),
        F.transform("m", lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"))).alias("matches"),
    )


def _labelled(words: Column, starts: Column, t: Template) -> Column:
    def found(s: Column) -> Column:
        # a start before the file's first word leaves the notice's first words out
        out, wanted = F.greatest(-s, F.lit(0)), _constant(t.words)
        pairs = F.zip_with(F.slice(words, s + out + 1, len(t.words)), F.slice(wanted, out + 1, len(t.words)), lambda a, b: F.coalesce(a == b, F.lit(False)))
        there = F.size(F.filter(pairs, lambda same: same))
        return F.struct(F.lit(t.label).alias("label"), s.cast("int").alias("start"), F.lit(t.base).alias("base"), (there / F.lit(len(t.words))).cast("double").alias("share"))

    return F.transform(starts, found)


def oracle_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same from plain positions: every template is tried at every word."""
    rows = []
    for t in templates:
        keys = "[" + ", ".join(f"{{'i': {i}, 'w': '{w}'}}" for i, w in t.key_words) + "]"
        words = "[" + ", ".join(f"'{w}'" for w in t.words) + "]"
        rows.append(f"('{t.label}', {str(t.base).lower()}, {keys}, {words})")
    return f"""
WITH t(label, base, keys, words) AS (VALUES {", ".join(rows)}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT r, w, unnest(w) AS word, unnest(generate_series(0, len(w) - 1)) AS i FROM d),
m AS (SELECT r, label, base, i - keys[1].i AS s,
             len(list_filter(generate_series(1, len(words)), lambda x: i - keys[1].i + x >= 1 AND w[i - keys[1].i + x] = words[x])) / len(words) AS share
      FROM p JOIN t ON p.word = t.keys[1].w
      WHERE len(list_filter(keys, lambda k: i - keys[1].i + k.i >= 0 AND w[i - keys[1].i + k.i + 1] = k.w)) = len(keys)),
a AS (SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
      FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN a USING (r)
"""
