"""Byte-level BPE encoding and decoding with a segment tree.

A match of the splitting pattern starts as one token a byte. A segment tree over the byte positions keeps,
at each leaf, the rank of the pair that starts there, and in each inner node the leftmost least of its two
children, so the root is always the next merge. A merge joins two live tokens, and updates three leaves
(the merged one, the one that died, the live neighbour before it) up to the root: logarithmic work. Many matches
of about equal length are merged side by side: the trees are the rows of one numpy array. Where there are few, each is merged
on its own, in packed arrays of about 40 bytes a byte, so a match of a million letters takes seconds.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import BLOCK_CHARS, blocks, map_texts
from .pieces import PieceEncoder, pack_units, strings

_NONE = np.int64(1) << 62
_POS = np.int64((1 << 32) - 1)
#: Cells of a group of trees merged side by side, and the fewest trees for which that pays.
CELLS, SIDE_BY_SIDE = 1 << 20, 48


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class SegmentTreeBPE:
    """Encoder and decoder for byte-pair ranks; `pattern` splits texts before the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        # white space as Unicode has it: the information separators U+001C..U+001F aren't
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        #: Whether a space and letters are one match.
        self.plain = r"| ?\p{L}+|" in pattern
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the ranks lack single bytes")
        self.base = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        self.rank_of = dict(zip(self.keys.tolist(), self.values.tolist(), strict=True))
        self.pieces = PieceEncoder(self._encode_texts, self._encode_words)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens; _NONE where the pair doesn't merge."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def _merge_rows(self, rows: list[bytes], size: int) -> list[bytes]:
        """Packed token ids of byte strings of at most `size` bytes (a power of two), by one segment tree each."""
        n = len(rows)
        length = np.fromiter(map(len, rows), np.int64, n)
        raw = np.zeros((n, size), np.uint8)
        raw[np.arange(size) < length[:, None]] = np.frombuffer(b"".join(rows), np.uint8)
        ids = self.base[raw]
        ids[np.arange(size) >= length[:, None]] = -1
        # neighbours; column `size` stands for none
        ids = np.concatenate([ids, np.full((n, 1), -1)], axis=1)
        after = np.broadcast_to(np.arange(1, size + 2), (n, size + 1)).copy()
        after[:, size] = size
        before = np.broadcast_to(np.arange(-1, size), (n, size + 1)).copy()
        tree = np.full((n, 2 * size), _NONE)
        left, right = ids[:, : size - 1], ids[:, 1:size]
        live = right >= 0
        rank = np.full((n, size), _NONE)
        rank[:, : size - 1][live] = self._pair(left[live], right[live])
        tree[:, size:] = np.where(rank < _NONE, rank << 32 | np.arange(size), _NONE)
        width = size
        while width > 1:
            tree[:, width // 2 : width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
            width //= 2
        row = np.flatnonzero(tree[:, 1] < _NONE)
        while row.size:
            root = tree[row, 1]
            at, merged = root & _POS, root >> 32
            dead = after[row, at]
            nxt = after[row, dead]
            prev = before[row, at]
            ids[row, at], ids[row, dead] = merged, -1
            after[row, at] = nxt
            before[row, nxt] = at
            # a place below 0 or past the end wraps to the column of id -1, which merges with nothing
            following = ids[row, nxt]
            own = np.where(following >= 0, self._pair(merged, np.maximum(following, 0)), _NONE)
            ahead = ids[row, np.where(prev >= 0, prev, size)]
            back = np.where(ahead >= 0, self._pair(np.maximum(ahead, 0), merged), _NONE)
            tree[row, size + at] = np.where(own < _NONE, own << 32 | at, _NONE)
            tree[row, size + dead] = _NONE
            has = prev >= 0
            tree[row[has], size + prev[has]] = np.where(back[has] < _NONE, back[has] << 32 | prev[has], _NONE)
            a, b, c = size + at, size + dead, np.where(has, size + prev, size + at)
            while a[0] > 1:
                a, b, c = a >> 1, b >> 1, c >> 1
                for node in (a, b, c):
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            row = row[tree[row, 1] < _NONE]
        ids = ids[:, :size]
        live = ids >= 0
        flat, ends = ids[live].astype("<u4").tobytes(), (4 * np.cumsum(live.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _merge_one(self, string: bytes, size: int) -> bytes:
        """Packed token ids of one byte string, by a segment tree of its own."""
        n, none, rank_of = len(string), int(_NONE), self.rank_of
        start = self.base[np.frombuffer(string, np.uint8)]
        leaves = np.full(size, _NONE)
        ranks = self._pair(start[:-1], start[1:])
        leaves[: n - 1] = np.where(ranks < _NONE, ranks << 32 | np.arange(n - 1), _NONE)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = array("q", np.concatenate([[_NONE], *levels[::-1]]).tobytes())
        ids = array("i", start.astype(np.int32).tobytes())
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n))

        def put(place: int, value: int) -> None:
            node = size + place
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    break
                tree[node] = least
                node >>= 1

        while (root := tree[1]) < none:
            at, merged = root & 0xFFFFFFFF, root >> 32
            dead = after[at]
            follow, ahead = after[dead], before[at]
            ids[at], ids[dead] = merged, -1
            after[at] = follow
            before[follow] = at
            rank = rank_of.get(merged << 32 | ids[follow]) if follow < n else None
            put(dead, none)
            put(at, none if rank is None else rank << 32 | at)
            if ahead >= 0:
                rank = rank_of.get(ids[ahead] << 32 | merged)
                put(ahead, none if rank is None else rank << 32 | ahead)
        found = np.frombuffer(ids, np.int32)
        return found[found >= 0].astype("<u4").tobytes()

    def merge(self, strings: list[bytes]) -> list[bytes]:
        """Token ids of each byte string, merged as one match of the pattern, as little-endian unsigned 32-bit integers."""
        out = [b""] * len(strings)
        groups: dict[int, list[int]] = {}
        for i, s in enumerate(strings):
            known = self.ranks.get(s)
            if known is not None:
                out[i] = known.to_bytes(4, "little")
            elif s:
                groups.setdefault(1 << max(1, (len(s) - 1).bit_length()), []).append(i)
        for size, members in groups.items():
            step = max(1, CELLS // size)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                if len(part) < SIDE_BY_SIDE:
                    for i in part:
                        out[i] = self._merge_one(strings[i], size)
                    continue
                for i, found in zip(part, self._merge_rows([strings[i] for i in part], size), strict=True):
                    out[i] = found
        return out

    def _encode_texts(self, texts: list[str]) -> list[bytes]:
        split = [self.pattern.findall(t) for t in texts]
        known = dict.fromkeys(m for ms in split for m in ms)
        known.update(zip(known, self.merge([m.encode("utf-8", "surrogatepass") for m in known]), strict=True))
        return [b"".join(map(known.__getitem__, ms)) for ms in split]

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        names = [" " + w for w in strings(words)]
        return pack_units(self.merge([w.encode() for w in names]) if self.plain else self._encode_texts(names))

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        return self.pieces.encode(texts)

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


_loaded: dict[tuple[str, str], SegmentTreeBPE] = {}


def codec(path: str, pattern: str) -> SegmentTreeBPE:
    """One codec for a worker process; its caches are bounded."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = SegmentTreeBPE(load_ranks(path), pattern)
    return _loaded[path, pattern]


def encode_texts(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, n_tokens, ids): each whole text's ids as little-endian unsigned 32-bit integers. Null: no ids. `path` names the file of ranks, on every executor."""
    path, pattern = path or _vocabulary()[0], pattern or _vocabulary()[1]

    def make():
        bpe = codec(path, pattern)

        def work(texts):
            ids = [x for _, part in blocks(texts, 4 * BLOCK_CHARS) for x in bpe.encode_bytes(part)]
            return {"n_tokens": [len(x) // 4 for x in ids], "ids": ids}

        return work

    return map_texts(df, [id_col], text_col, "n_tokens long, ids binary", make)


def bpe_round_trip(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode every whole text, decode the ids, digest both.

    Null and empty texts have no tokens. Equal texts give equal digests; repeated rows and ids give a row each; an empty table gives an empty
    one; columns besides id and text are not read, whatever their names. Of pairs of equal rank the leftmost is merged first. Nothing is
    shuffled, and ids never travel between processes.
    """
    path, pattern = path or _vocabulary()[0], pattern or _vocabulary()[1]

    def make():
        bpe = codec(path, pattern)

        def work(texts):
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for _, part in blocks(texts, 4 * BLOCK_CHARS):
                for ids in bpe.encode_bytes(part):
                    out["n_tokens"].append(len(ids) // 4)
                    out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
            return out

        return work

    return map_texts(df, [id_col], text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
