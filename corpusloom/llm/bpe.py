"""Byte-level BPE encoding and decoding over segment trees.

A text is cut into the matches of the tokenizer's pattern, and each match is merged on its own. Over a match's byte positions
stands a segment tree whose leaves hold the rank of the pair that starts there (or none) and whose nodes hold the least rank
below them, the leftmost on ties. The root names the next merge; a merge changes the leaves of at most three live
neighbours, each a point update along one path to the root. A match of n bytes so takes O(n log n) steps however long it is.

Matches are short and repeat, so a task collects a batch's unseen matches, merges those of equal tree size together in numpy
(one tree per row), and keeps results in a cache of bounded size. Longer matches have a plain tree each.

Defined cases: a null or empty text has no ids; texts may be of any length; every row is returned; an empty table gives an
empty table. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Sequence
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm.texts import holds, map_rows, sha256

NONE = np.int32(2**31 - 1)
#: Matches of at most so many bytes are merged together; results kept by a worker, and letters in them, in each of two generations.
TOGETHER, KEPT, KEPT_LETTERS = 64, 200_000, 4_000_000

# Letters, numbers and white space up to U+024F, where Python's re can stand in for the pattern's classes.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc\xbd\xbe", "\\t-\\r \x85\xa0"
_BEYOND = re.compile("[^\x00-ɏ]")
_LATIN = re.compile(f" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: The pattern for which _LATIN stands.
LATIN_FOR = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary:
    """Ranks of byte strings, and the ranks of pairs as sorted keys."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.tokens = {str(r): t for t, r in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, values = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        order = np.argsort(keys := np.array(keys, dtype=np.int64))
        self.keys, self.values = keys[order], np.array(values, dtype=np.int32)[order]
        self.pairs = dict(zip(self.keys.tolist(), self.values.tolist(), strict=True))
        self.whole = regex.compile(pattern)
        self.latin = pattern == LATIN_FOR
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.letters = 0

    def split(self, text: str) -> list[str]:
        if self.latin and (text.isascii() or not _BEYOND.search(text)):
            return _LATIN.findall(text)
        return [m[0] for m in self.whole.finditer(text)]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], NONE)

    def ids(self, pieces: Iterable[str]) -> None:
        """Bring the ids of all ``pieces`` into the cache."""
        young, old = self.young, self.old
        if len(young) > KEPT or self.letters > KEPT_LETTERS:
            self.old, self.young, self.letters = young, {}, 0
            young, old = self.young, self.old
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            if piece in young:
                continue
            self.letters += len(piece)
            if piece in old:
                young[piece] = old[piece]
                continue
            data = piece.encode()
            if (rank := self.ranks.get(data)) is not None:
                young[piece] = str(rank)
            elif len(data) > TOGETHER:
                young[piece] = " ".join(map(str, merge_one(data, self)))
            else:
                groups.setdefault(max(4, 1 << (len(data) - 1).bit_length()), []).append((piece, data))
        for size, members in groups.items():
            for i in range(0, len(members), 8192):
                part = members[i : i + 8192]
                for (piece, _), ids in zip(part, merge_together([d for _, d in part], size, self), strict=True):
                    young[piece] = " ".join(map(str, ids))


def merge_together(pieces: Sequence[bytes], size: int, vocabulary: Vocabulary) -> list[list[int]]:
    """Ids of each piece; size: a power of two, at least each piece's length. One segment tree per row."""
    n = len(pieces)
    lengths = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8).reshape(n, size)
    token = vocabulary.byte_ids[raw]
    live = np.arange(size)[None, :] < lengths[:, None]
    after = np.tile(np.arange(1, size + 1), (n, 1))
    before = np.tile(np.arange(-1, size - 1), (n, 1))
    tree = np.full((n, 2 * size), NONE, dtype=np.int64)
    place = np.arange(size)
    ranks = vocabulary.pair_ranks(token[:, :-1], token[:, 1:])
    starts = live[:, 1:] & (ranks != NONE)
    tree[:, size : 2 * size - 1][starts] = (ranks.astype(np.int64) * size + place[:-1])[starts]
    for node in range(size - 1, 0, -1):
        np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])

    def update(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + size
        tree[rows, node] = value
        while (node := node >> 1)[0] if len(node) else 0:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def pair_at(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        rank = vocabulary.pair_ranks(token[rows, left], token[rows, right])
        return np.where(rank == NONE, np.int64(NONE), rank.astype(np.int64) * size + left)

    rows = np.flatnonzero(tree[:, 1] != NONE)
    while len(rows):
        least = tree[rows, 1]
        at = (least % size).astype(np.int64)
        gone = after[rows, at]
        follower = after[rows, gone]
        token[rows, at] = least // size
        live[rows, gone] = False
        after[rows, at] = follower
        update(rows, gone, np.full(len(rows), NONE, dtype=np.int64))
        has = follower < lengths[rows]
        r, a, f = rows[has], at[has], follower[has]
        before[r, f] = a
        value = np.full(len(rows), NONE, dtype=np.int64)
        value[has] = pair_at(r, a, f)
        update(rows, at, value)
        leader = before[rows, at]
        has = leader >= 0
        r, a, o = rows[has], at[has], leader[has]
        if len(r):
            update(r, o, pair_at(r, o, a))
        rows = rows[tree[rows, 1] != NONE]
    ids, counts = token[live], live.sum(axis=1)
    flat, ends = ids.tolist(), np.cumsum(counts).tolist()
    return [flat[e - c : e] for e, c in zip(ends, counts.tolist(), strict=True)]


def merge_one(data: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids of one long piece."""
    n, none, pairs = len(data), int(NONE) << 32, vocabulary.pairs
    size = 1 << (n - 1).bit_length() if n > 1 else 1
    token: list[int] = vocabulary.byte_ids[np.frombuffer(data, dtype=np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def pair_at(i: int, j: int) -> int:
        rank = pairs.get(token[i] << 32 | token[j])
        return none if rank is None else rank << 32 | i

    tree = [none] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = pair_at(i, i + 1)
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def update(leaf: int, value: int) -> None:
        node = leaf + size
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    gone = bytearray(n)
    while n > 1 and tree[1] != none:
        at = tree[1] & 0xFFFFFFFF
        dead = after[at]
        follower = after[dead]
        token[at] = tree[1] >> 32
        gone[dead] = 1
        after[at] = follower
        update(dead, none)
        if follower < n:
            before[follower] = at
            update(at, pair_at(at, follower))
        else:
            update(at, none)
        if before[at] >= 0:
            update(before[at], pair_at(before[at], at))
    return [t for t, dead in zip(token, gone, strict=True) if not dead]


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


#: Outputs that encode() can give, beside doc_id.
OUTPUTS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "ids_sha256": T.StringType(),
    "decoded": T.BinaryType(),
    "decoded_sha256": T.StringType(),
}


def encode(docs: DataFrame, path: str, pattern: str, outputs: Sequence[str] = ("n_tokens", "ids")) -> DataFrame:
    """doc_id and the chosen outputs for every text. decoded: the bytes that the ids stand for, read back from the ids."""
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(o, OUTPUTS[o]) for o in outputs)])

    def run(cols: dict[str, list]) -> dict[str, list]:
        holds("bpe", vocabulary.cache_clear)
        known = vocabulary(path, pattern)
        out: dict[str, list] = {"doc_id": cols["doc_id"]} | {o: [] for o in outputs}
        split = [known.split(text) if text else [] for text in cols["text"]]
        todo = set()
        for start in range(0, len(split), 256):
            part = split[start : start + 256]
            todo.clear()
            for pieces in part:
                todo.update(pieces)
            known.ids(todo)
            cache, tokens = known.young, known.tokens
            for pieces in part:
                ids = " ".join(map(cache.__getitem__, pieces))
                if "n_tokens" in out:
                    out["n_tokens"].append(ids.count(" ") + 1 if ids else 0)
                if "ids" in out:
                    out["ids"].append(list(map(int, ids.split(" "))) if ids else [])
                if "ids_sha256" in out:
                    out["ids_sha256"].append(sha256(ids))
                if "decoded" in out or "decoded_sha256" in out:
                    data = b"".join(map(tokens.__getitem__, ids.split(" "))) if ids else b""
                    if "decoded" in out:
                        out["decoded"].append(data)
                    if "decoded_sha256" in out:
                        out["decoded_sha256"].append(sha256(data))
        return out

    return map_rows(docs.select("doc_id", "text"), run, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text for a table of doc_id and ids; bytes that aren't UTF-8 become replacement characters."""
    schema = T.StructType([encoded.schema["doc_id"], T.StructField("text", T.StringType())])

    def run(cols: dict[str, list]) -> dict[str, list]:
        tokens = vocabulary(path, pattern).tokens
        return {"doc_id": cols["doc_id"], "text": [b"".join(tokens[str(i)] for i in ids or ()).decode("utf-8", "replace") for ids in cols["ids"]]}

    return map_rows(encoded.select("doc_id", "ids"), run, schema)


DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, DIGESTS)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
