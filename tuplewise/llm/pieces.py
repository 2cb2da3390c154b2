"""Encode many texts at once, by distinct words.

Byte-level BPE first splits a text by a pattern, then merges inside each match. Wherever a single space
stands before a non-space, a match begins at that space, so the text may be cut there: the pieces are
encoded alone and joined. A space with white space on both sides (or before it at the text's end) lies inside a
longer run, where this doesn't hold; such texts are encoded whole. A piece of letters and then ASCII marks is
two matches, so words are encoded, and remembered, apart from the marks behind them.

Texts are cut and their distinct pieces found by Arrow's kernels; Python sees each distinct word of a block once. The
ids of all texts are then gathered from those of the words by numpy, as one flat array with the places where texts begin.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that the table holds before it begins anew; longer words aren't kept.
WORDS, LONGEST = 700_000, 64
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Longer runs of marks are encoded with their word.
TAIL = 8


def pack_units(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed ids as one array, and how many each unit has."""
    return np.frombuffer(b"".join(units), "<u4"), np.fromiter(map(len, units), np.int64, len(units)) // 4


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The runs flat[starts[i] : starts[i] + sizes[i]] for i in pick, one behind the other."""
    n = sizes[pick]
    ends = np.cumsum(n)
    shift = starts[pick] - (ends - n)
    return flat[np.repeat(shift, n) + np.arange(ends[-1] if len(ends) else 0)]


def strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


class WordTable:
    """Ids of words met before: a place for each word, and the ids of all places in one array."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def places(self, words: pa.Array, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A place for each of some distinct words; those not met before are encoded."""
        if len(self.place) > self.limit:
            self.clear()
        names = strings(words)
        get = self.place.get
        out = np.fromiter(map(get, names, repeat(-1)), np.int64, len(names))
        lacking = np.flatnonzero(out < 0)
        if len(lacking):
            flat, sizes = encode(words.take(pa.array(lacking)))
            start = len(self.sizes)
            out[lacking] = np.arange(start, start + len(lacking))
            self.place.update(zip(map(names.__getitem__, lacking.tolist()), range(start, start + len(lacking)), strict=True))
            self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        return out


class PieceEncoder:
    """encode_texts: whole texts to packed unsigned 32-bit ids each; encode_words: an Arrow array of words to the ids of a space and each word, in one array, and their counts."""

    def __init__(self, encode_texts: Callable[[list[str]], list[bytes]], encode_words: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        self.encode_texts, self.encode_words = encode_texts, encode_words
        self.words = WordTable(WORDS)

    def _units(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of parts of distinct pieces (each behind a space), their counts, and for each piece its first and second part; -1: none."""
        cores = pc.utf8_rtrim(pieces, MARKS)
        size, core_size = pc.binary_length(pieces).to_numpy(), pc.binary_length(cores).to_numpy()
        plain = np.logical_and(pc.utf8_is_alpha(cores).to_numpy(zero_copy_only=False), core_size > 0) & (core_size <= LONGEST) & (size - core_size <= TAIL)
        first, second = np.full(len(pieces), -1, np.int64), np.full(len(pieces), -1, np.int64)
        if plain.any():
            coded = cores.filter(pa.array(plain)).dictionary_encode()
            first[plain] = self.words.places(coded.dictionary, self.encode_words)[coded.indices.to_numpy()]
        base = len(self.words.sizes)
        units: list[bytes] = []
        # marks are ASCII: as many bytes as characters
        for n in range(1, TAIL + 1):
            marked = np.flatnonzero(plain & (size - core_size == n))
            if len(marked):
                tails = pc.utf8_slice_codeunits(pieces.take(pa.array(marked)), -n).dictionary_encode()
                second[marked] = base + len(units) + tails.indices.to_numpy()
                units += self.encode_texts(strings(tails.dictionary))
        odd = np.flatnonzero(~plain)
        if len(odd):
            first[odd] = base + np.arange(len(units), len(units) + len(odd))
            units += self.encode_texts([" " + p for p in strings(pieces.take(pa.array(odd)))])
        flat, sizes = pack_units(units)
        return np.concatenate([self.words.flat, flat]), np.concatenate([self.words.sizes, sizes]), first, second

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        if not texts:
            return []
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        index = coded.indices.to_numpy().copy()
        pieces = coded.dictionary.cast(pa.string())
        heads = offsets[:-1]
        whole = np.flatnonzero(inside_runs(pieces, index, offsets)).tolist()
        flat, sizes, first, second = self._units(pieces)
        # -1 picks an empty run at the end
        sizes = np.append(sizes, 0)
        starts = np.cumsum(sizes) - sizes
        order = np.stack([first, second], axis=1).ravel()
        ids = ragged(flat, starts, sizes, order)
        # a text's first piece has no space before it: it is a unit of its own
        more, more_sizes = pack_units(self.encode_texts(strings(split.values.take(pa.array(heads)))))
        ends = 4 * np.cumsum(np.concatenate([[0], sizes[first] + sizes[second], more_sizes]))
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate([ids, more]))])
        index[heads] = np.arange(len(pieces), len(units))
        # all ids, one text behind the other
        taken = units.take(pa.array(index))
        _, at, data = taken.buffers()
        bounds = np.frombuffer(at, np.int64)[offsets].tolist()
        raw = memoryview(data)
        out = [bytes(raw[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        for i, x in zip(whole, self.encode_texts([texts[i] for i in whole]), strict=True):
            out[i] = x
        return out


def inside_runs(pieces: pa.Array, index: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have a space with white space before it and, behind it, white space or the end; pieces: what stands between spaces."""
    size = pc.binary_length(pieces).to_numpy()
    empty = size == 0
    opens = empty | (pc.binary_length(pc.utf8_ltrim_whitespace(pieces)).to_numpy() < size)
    closes = empty | (pc.binary_length(pc.utf8_rtrim_whitespace(pieces)).to_numpy() < size)
    before, after = closes[index], opens[index]
    heads = offsets[:-1]
    # nothing stands before an empty first piece, and no space before any first piece
    before[heads] &= ~empty[index[heads]]
    bad = np.zeros(len(index), bool)
    bad[1:] = before[:-1] & after[1:]
    bad[heads] = False
    return np.logical_or.reduceat(bad, heads)
