"""Language identification by hierarchical discrimination.

Languages are grouped into families. A text is first given a family, then a language of it; both by linear support
vector machines, one versus one: each pair has a machine of its own, the machines vote, margins break ties. Features are
hashed byte trigrams of the letters (everything else is a space), as shares of a text's trigrams, so that scoring is
one pass over the bytes: each trigram's weight for every machine is looked up and summed.

Machines are fitted on the driver by subgradient descent on the hinge loss, from a bounded sample of labelled rows
(PER_LANG for each language); only fixed-size feature vectors of the sample reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, doc_crc, fresh, map_texts, quoted
from .samples import bounded, sample_ids

#: Families of languages by ISO 639-1 code; other languages are a family each.
FAMILIES = {
    "germanic": ("da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
PER_LANG, DIM_BITS, ROUNDS, UND = 400, 12, 300, "und"
DIM = 1 << DIM_BITS
#: Trigram shares are small; scaled, a text's vector has a length of about 1.
SCALE = 24.0
#: A decision below this is a rejection: of the held-out rows of sf0.1 that score less (5 of 1,960), 3 are given a wrong language; of the rest 7.
MIN_SCORE = 0.55
#: Bytes of text whose trigrams are looked up at once.
CHUNK = 1 << 20

_TABLE = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_LETTER = regex.compile(r"\p{L}")


def family_of(lang: str, families: dict[str, tuple[str, ...]] = FAMILIES) -> str:
    return next((name for name, langs in families.items() if lang in langs), lang)


def trigram_places(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts in a row, and where each text's begin; a text has spaces before and behind."""
    parts = [b" " + b" ".join(t.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()) + b"  " for t in texts]
    b = np.frombuffer(b"".join(parts), np.uint8)
    out = np.empty(max(0, len(b) - 2), np.uint16)
    for at in range(0, len(out), CHUNK):
        w = b[at : at + CHUNK + 2].astype(np.uint32)
        out[at : at + CHUNK] = (w[:-2] << np.uint32(16) | w[1:-1] << np.uint32(8) | w[2:]) * np.uint32(2654435761) >> np.uint32(32 - DIM_BITS)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])[:-1].astype(np.int64)
    return out, starts


def features(texts: list[str]) -> np.ndarray:
    """A row of DIM trigram shares for each text."""
    out = np.zeros((len(texts), DIM), np.float32)
    for i, text in enumerate(texts):
        places, _ = trigram_places([text])
        counts = sum(np.bincount(places[at : at + CHUNK], minlength=DIM) for at in range(0, len(places), CHUNK))
        out[i] = counts * np.float32(SCALE / len(places))
    return out


def fit_machine(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear support vector machine for labels +1 and -1 (both classes weigh the same): (weights, offset)."""
    x, y = np.ascontiguousarray(x, np.float32), y.astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    seen = np.full(x.shape[1] + 1, 1e-8, np.float32)
    for _ in range(rounds):
        inside = y * (x @ w + b) < 1
        pull = np.where(inside, weight * y, np.float32(0))
        grad = np.append(np.float32(decay) * w - pull @ x, -pull.sum())
        seen += grad * grad
        step = np.float32(0.5) * grad / np.sqrt(seen)
        w -= step[:-1]
        b -= step[-1]
    return w, float(b)


@dataclass
class Model:
    """Machines as columns of one table: `teams` says which pair of names each one tells apart."""

    families: list[str] = field(default_factory=list)
    langs: dict[str, list[str]] = field(default_factory=dict)
    #: (group: "" for families or a family, first name, second name)
    teams: list[tuple[str, str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((DIM, 0), np.float32))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margins(self, texts: list[str]) -> np.ndarray:
        """A margin for each text and machine; above 0 for the first name."""
        places, starts = trigram_places(texts)
        if not texts or not len(self.teams):
            return np.zeros((len(texts), len(self.teams)))
        ends = np.append(starts[1:], len(places) + 2)
        counts = ends - starts - 2
        out = np.empty((len(texts), len(self.teams)))
        # a trigram across two texts belongs to none: the two last places of a text are left out
        keep = np.ones(len(places), bool)
        keep[(ends[:-1, None] - np.array([1, 2])).ravel()] = False
        for k in range(len(self.teams)):
            column = self.weights[:, k]
            if len(places) <= 2 * CHUNK:
                total = np.add.reduceat(np.where(keep, column[places], np.float32(0)), starts, dtype=np.float64)
            else:
                # a long text: its trigrams are summed chunk by chunk
                total = np.zeros(len(texts))
                for i, (a, b) in enumerate(zip(starts.tolist(), (ends - 2).tolist(), strict=True)):
                    total[i] = sum(column[places[at : min(b, at + CHUNK)]].sum(dtype=np.float64) for at in range(a, b, CHUNK))
            out[:, k] = total * (SCALE / counts) + self.offsets[k]
        return out

    def _choose(self, group: str, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the name with most votes (margins break ties), and its confidence against the strongest rival."""
        n = len(margins)
        if len(names) == 1:
            return np.zeros(n, np.int64), np.ones(n)
        votes, against = np.zeros((n, len(names))), np.full((n, len(names)), np.inf)
        for k, (g, a, b) in enumerate(self.teams):
            if g == group:
                i, j, m = names.index(a), names.index(b), margins[:, k]
                votes[:, i] += (m > 0) + 0.001 * np.tanh(m)
                votes[:, j] += (m <= 0) - 0.001 * np.tanh(m)
                against[:, i] = np.minimum(against[:, i], m)
                against[:, j] = np.minimum(against[:, j], -m)
        best = votes.argmax(axis=1)
        return best, 1 / (1 + np.exp(-3 * against[np.arange(n), best]))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Languages and scores; UND and 0 where there is no letter, or nothing was learned."""
        if not self.families:
            return [UND] * len(texts), [0.0] * len(texts)
        margins = self.margins(texts)
        family, sure = self._choose("", self.families, margins)
        langs, scores = np.empty(len(texts), object), np.zeros(len(texts))
        for f, name in enumerate(self.families):
            some = np.flatnonzero(family == f)
            pick, within = self._choose(name, self.langs[name], margins[some])
            langs[some] = np.array(self.langs[name], object)[pick]
            scores[some] = sure[some] * within
        for i, t in enumerate(texts):
            if not _LETTER.search(t):
                langs[i], scores[i] = UND, 0.0
        return langs.tolist(), scores.tolist()


def fit(x: np.ndarray, langs: list[str], families: dict[str, tuple[str, ...]] = FAMILIES) -> Model:
    """Machines for all pairs of families, and for all pairs of languages inside each."""
    known = sorted(set(langs))
    lang = np.array(langs, object)
    family = np.array([family_of(v, families) for v in langs], object)
    model = Model(families=sorted({family_of(v, families) for v in known}))
    model.langs = {f: [v for v in known if family_of(v, families) == f] for f in model.families}
    columns, offsets = [], []
    for group, names, of in [("", model.families, family), *[(f, model.langs[f], lang) for f in model.families]]:
        for a, b in combinations(names, 2):
            some = (of == a) | (of == b)
            w, o = fit_machine(x[some], np.where(of[some] == a, 1.0, -1.0))
            model.teams.append((group, a, b))
            columns.append(w)
            offsets.append(o)
    if columns:
        model.weights, model.offsets = np.array(columns, np.float32).T.copy(), np.array(offsets)
    return model


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = PER_LANG, families: dict[str, tuple[str, ...]] = FAMILIES) -> Model:
    """Fit on the sample of rows whose crc32(id as text) mod 5 isn't 0; of them only text and language are used.

    The driver gets about per_lang vectors of DIM numbers for each language and never more than twice that (whole texts stay on the executors).
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null").where(doc_crc(F.col("id")) % 5 != 0)
    ids = sample_ids(labelled, "id", F.col("lang"), per_lang, salt=2)
    most = 2 * per_lang * max(1, ids.select("label").distinct().count())
    chosen = labelled.join(F.broadcast(bounded(ids.select("id").distinct(), most)), "id", "left_semi")

    def make():
        def work(texts):
            return {"x": [features([t or ""])[0].astype("<f2").tobytes() for t in texts]}

        return work

    rows = map_texts(bounded(chosen, most), ["id", "lang"], "text", "x binary", make).collect()
    rows.sort(key=lambda r: (r["id"], r["lang"], r["x"]))
    x = np.array([np.frombuffer(r["x"], "<f2") for r in rows], np.float32).reshape(len(rows), DIM)
    return fit(x, [r["lang"] for r in rows], families)


def identify(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score) for every row, from its whole text alone.

    Null, empty and letterless texts are UND with score 0; equal texts get equal results; repeated rows and ids give a row each; an empty table
    an empty one; columns besides id and text are not read, whatever their names. Memory: 16 bytes a byte of a block's or the longest text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM numbers a machine

    def make():
        m = shared.value

        def work(texts):
            langs, scores = [], []
            for _, part in blocks(texts):
                a, b = m.predict(part)
                langs += a
                scores += b
            return {"lang_pred": langs, "score": scores}

        return work

    return map_texts(docs, [id_col], text_col, "lang_pred string, score double", make)


def language_table(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, lang_pred, score): learn from the rows that aren't held out, predict all.

    Null texts and texts without a letter are UND with score 0, as is everything if no row has a language. Repeated rows
    and ids give a row each; an empty table an empty one. A null id is neither held out nor learned from.
    """
    found = identify(docs, train(docs, text_col, lang_col, id_col), text_col, id_col)
    return found.select(id_col, F.coalesce(doc_crc(F.col(id_col)) % 5 == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", min_score: float = MIN_SCORE) -> DataFrame:
    """docs without the rows that have no language: UND, or a score below min_score. One pass; no text is shuffled.

    Each row is judged by its own text: null and empty ones go, null or repeated ids and extra columns of any name don't matter; an empty table stays one.
    Where no row has a language, nothing is recognised and every row goes.
    """
    model = train(docs, text_col, lang_col, id_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    kept = docs.columns
    flag = fresh("keep", kept)

    def make():
        m = shared.value

        def work(texts):
            keep = []
            for _, part in blocks(texts):
                keep += [v != UND and s >= min_score for v, s in zip(*m.predict(part), strict=True)]
            return {flag: keep}

        return work

    return map_texts(docs, kept, text_col, f"{flag} boolean", make).where(F.col(flag)).select(*quoted(kept))
