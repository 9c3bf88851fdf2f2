"""Cross-tokenizer alignment by a dangling-suffix transducer, and how firmly tokens of two vocabularies belong together.

Two tokenizers cut the same bytes. The transducer reads both token streams: its state is the side that leads and the bytes that it is
ahead (the dangling suffix). The other side's next token either lies within them, ends with them, or goes beyond and takes the lead;
when no byte dangles, a group closes. A transition depends on the residual and the next token alone, so transitions are memoised. If
a token contradicts the residual, or a side ends early, the streams don't spell the same bytes and the text has no tokens.

Neither vocabulary has a token that goes on over a space after another character (``Pair`` verifies this, and whole texts are
aligned otherwise), so no byte dangles where a space follows a non-space. Texts are cut there, each new piece is tokenised and
sent through the transducer once, and a worker keeps what came out (bounded by entries and letters).

Corpus-wide counts: a first table holds a row per text with its distinct id pairs and how often each is linked, packed. Tasks count
the documents of each pair, and Spark adds these counts up (rows of 12 bytes, combined before the shuffle; a pair that all documents
have is one row a task). The counts come back to the texts as sorted arrays, at most ``SLICE`` pairs at a time: where the corpus has more
pairs, further passes over the packed table add what is missing, so no broadcast grows with the corpus and no text is shuffled.

Defined cases: a null or empty text, or one that either side doesn't spell byte for byte, has zeros and an empty groups_sha256; texts of
any length; equal rows are documents of their own; a null id is passed through; an empty table gives an empty table. Special tokens
are ordinary text.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.staging import stage, stage_at, unstage
from corpusloom.llm.texts import holds, map_rows, sha256

#: Pieces (and letters in them) and transitions that a worker keeps in each of two generations; pairs whose counts are sent at once.
KEPT, KEPT_LETTERS, KEPT_STEPS, SLICE = 150_000, 3_000_000, 300_000, 4_000_000
#: Pieces that are put together at once.
PORTION = 150_000

CUT = re.compile(r"(?<=\S)(?= )")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: visible Latin-1 characters stand for themselves, the others for U+0100 on."""
    seen = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_tokens(path: str) -> dict[bytes, int]:
    """Bytes and ids of a byte-level vocabulary file, without its special tokens."""
    with open(path, encoding="utf-8") as lines:
        said = json.load(lines)
    letters, special = byte_letters(), {t["content"] for t in said["added_tokens"] if t["special"]}
    return {bytes(letters[c] for c in token): i for token, i in said["model"]["vocab"].items() if token not in special}


def piece_bytes(piece: str) -> bytes:
    if m := re.fullmatch(r"<0x([0-9A-F]{2})>", piece):
        return bytes([int(m[1], 16)])
    return piece.replace("▁", " ").encode()


class Transducer:
    """Groups of two token streams over the same bytes. A state is (side that moves next, what the other side is ahead, transitions by
    token); the state without a residual is where groups close."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.tokens = a, b
        self.clear()

    def clear(self) -> None:
        self.kept = 0
        self.start: tuple = (0, b"", {})
        self.dead: tuple = (0, b"", {})
        self.states = {(0, b""): self.start}
        self.names: dict[tuple, tuple[str, tuple[tuple[int, int], ...]]] = {}

    def move(self, state: tuple, token: int) -> tuple:
        """The state behind ``token``, and remember it; dead if the token contradicts the residual."""
        side, residual, known = state
        own = self.tokens[side][token]
        if len(own) <= len(residual):
            after = (side, residual[len(own) :]) if residual.startswith(own) else None
        else:
            after = (1 - side, own[len(residual) :]) if own.startswith(residual) else None
        if after is None:
            found = self.dead
        elif not after[1]:
            found = self.start
        else:
            found = self.states.setdefault(after, (*after, {}))
        known[token] = found
        self.kept += 1
        return found

    def group(self, key: tuple) -> tuple[str, tuple[tuple[int, int], ...]]:
        """A group (its ids of either side) as text, and its links."""
        x, y = (part if isinstance(part, tuple) else (part,) for part in key)
        found = self.names[key] = f"{','.join(map(str, x))}|{','.join(map(str, y))}", tuple((u, v) for u in x for v in y)
        self.kept += 1
        return found

    def groups(self, a: list[int], b: list[int]) -> list[tuple[str, tuple[tuple[int, int], ...]]] | None:
        """The groups in order, each as text and links; None if the streams don't spell the same bytes."""
        if self.kept > KEPT_STEPS:
            self.clear()
        start, dead, names, found = self.start, self.dead, self.names, []
        i = j = first_a = first_b = 0
        n, m = len(a), len(b)
        state = start
        while i < n or j < m or state is not start:
            if state[0]:
                if j == m:
                    return None
                after = state[2].get(b[j]) or self.move(state, b[j])
                j += 1
            else:
                if i == n:
                    return None
                after = state[2].get(a[i]) or self.move(state, a[i])
                i += 1
            if after is start:
                if i - first_a == 1 and j - first_b == 1:
                    key = (a[first_a], b[first_b])
                else:
                    key = (tuple(a[first_a:i]), tuple(b[first_b:j]))
                found.append(names.get(key) or self.group(key))
                first_a, first_b = i, j
            elif after is dead:
                return None
            state = after
        return found


class Pair:
    """Both tokenizers: a, ids by the bytes of a byte-level vocabulary; b, a sentencepiece model."""

    def __init__(self, a: dict[bytes, int], pattern: str, model: bytes):
        import sentencepiece

        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=a, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.width = len(names)
        of_a = [b""] * (max(a.values()) + 1)
        for token, i in a.items():
            of_a[i] = token
        # the unknown piece and control pieces spell nothing that a text could have
        of_b = [b"" if self.b.is_unknown(i) or self.b.is_control(i) else piece_bytes(x) for i, x in enumerate(names)]
        self.transducer = Transducer(of_a, of_b)
        self.space = self.b.piece_to_id("▁")
        # of a, white space of several bytes may stand before a space; pieces are only cut behind other characters
        within = any(re.search(r"\S ", x.decode(errors="ignore")) for x in of_a) or any(re.search(rb"[^ ] ", x) for x in of_b)
        self.cut = not within and self.b.encode("a b") == self.b.encode("a") + self.b.encode("b")
        self.clear()

    def clear(self) -> None:
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}
        self.letters = 0
        self.transducer.clear()

    def pieces(self, text: str) -> list[str]:
        """The text behind a space, in pieces that both sides cut alike."""
        return CUT.split(" " + text) if self.cut else [" " + text]

    def learn(self, texts: list[list[str]]) -> None:
        """Bring what comes out for all pieces into the cache."""
        if len(self.young) > KEPT or self.letters > KEPT_LETTERS:
            self.old, self.young, self.letters = self.young, {}, 0
        young, old = self.young, self.old
        fresh = []
        for piece in {p for pieces in texts for p in pieces}:
            if piece in young:
                continue
            self.letters += len(piece)
            if piece in old:
                young[piece] = old[piece]
            else:
                fresh.append(piece)
        of_b = self.b.encode([p[1:] for p in fresh], num_threads=1)
        for piece, b in zip(fresh, of_b, strict=True):
            young[piece] = self.align(self.a.encode_ordinary(piece), [self.space] if piece == " " else b)

    def align(self, a: list[int], b: list[int]) -> tuple[int, int, int, str, bytes] | None:
        """Numbers of tokens and groups, the groups as text, and the linked pairs (a id times the size of b's vocabulary, plus b id)."""
        groups = self.transducer.groups(a, b)
        if groups is None:
            return None
        width = self.width
        links = array("q", [u * width + v for _, linked in groups for u, v in linked])
        return len(a), len(b), len(groups), ";".join([text for text, _ in groups]), links.tobytes()


PAIRS: dict[int, Pair] = {}


def pack(values: np.ndarray) -> bytes:
    """Whole numbers below 2^32, byte by byte in four planes, which compress well."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, n_best long, count_sum long"


def _align(sent, place: int):
    def run(cols: dict[str, list]) -> dict[str, list]:
        pair = PAIRS.get(place)
        if pair is None:
            PAIRS.clear()
            PAIRS[place] = pair = Pair(*sent.value)
        holds("alignment", pair.clear)
        out: dict[str, list] = {"doc_id": cols["doc_id"]} | {c.split(" ")[0]: [] for c in COUNTS.split(", ")}
        texts = [pair.pieces(t) if t else [] for t in cols["text"]]
        start = 0
        while start < len(texts):
            end, n = start, 0
            while end < len(texts) and (end == start or n + len(texts[end]) <= PORTION):
                n += len(texts[end])
                end += 1
            _portion(pair, texts[start:end], out)
            start = end
        return out

    return run


def _portion(pair: Pair, texts: list[list[str]], out: dict[str, list]) -> None:
    pair.learn(texts)
    known = pair.young
    for pieces in texts:
        found = [known[p] for p in pieces]
        if not found or None in found:
            sizes, texts_of, links = ((0,), (0,), (0,)), (), ()
        else:
            *sizes, texts_of, links = zip(*found, strict=True)
        for c, values in zip(("n_a", "n_b", "n_groups"), sizes, strict=True):
            out[c].append(sum(values))
        out["groups_sha256"].append(sha256(";".join(texts_of)) if texts_of else "")
        linked = np.frombuffer(b"".join(links), dtype=np.int64)
        out["n_links"].append(len(linked))
        ids, times = np.unique(linked, return_counts=True)
        out["pairs"].append(pack(np.diff(ids, prepend=0)))  # steps between sorted pairs
        out["times"].append(pack(times))
        out["n_best"].append(0)
        out["count_sum"].append(0)


def aligned(docs: DataFrame, a: str, b: str, pattern: str) -> tuple[DataFrame, int]:
    """doc_id and COUNTS of every text, the sums still 0; and the size of b's vocabulary. a, b: files of the tokenizers, read on the driver."""
    import sentencepiece

    spark = docs.sparkSession
    with open(b, "rb") as model:
        sent = byte_level_tokens(a), pattern, model.read()
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(COUNTS).fields])
    held = spark.sparkContext.broadcast(sent)  # of the size of the vocabularies
    return map_rows(docs.select("doc_id", "text"), _align(held, held._jbroadcast.id()), schema), sentencepiece.SentencePieceProcessor(model_proto=sent[2]).get_piece_size()


def _counted(batches):
    """Of packed pairs: pair, count rows, combined over some batches."""
    import pyarrow as pa

    held: list[np.ndarray] = []
    size = 0

    def give():
        pairs, count = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(count.astype(np.int64))], names=["pair", "n"])

    for batch in batches:
        for data in batch.column(0):
            data = data.as_py()
            if data:
                held.append(np.cumsum(unpack(data)))
                size += len(held[-1])
                if size > 2_000_000:
                    yield give()
                    held, size = [], 0
    if held:
        yield give()


def pair_counts(packed: DataFrame, width: int) -> DataFrame:
    """pair, n (documents that link it), best (whether no pair of its first id has more)."""
    counts = stage(packed.select("pairs").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    first = F.floor(F.col("pair") / width).alias("first")
    most = counts.groupBy(first).agg(F.max("n").alias("most"))
    return counts.select("pair", "n", first).join(most, "first").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _summed(sent):
    """Add to n_best and count_sum what the pairs of one slice give."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        known, n, best = sent.value
        for i, data in enumerate(cols["pairs"]):
            if data and len(known):
                pairs, times = np.cumsum(unpack(data)), unpack(cols["times"][i])
                at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                here = known[at] == pairs
                at, times = at[here], times[here]
                cols["n_best"][i] += int(times[best[at]].sum())
                cols["count_sum"][i] += int((times * n[at]).sum())
        return cols

    return run


def align(docs: DataFrame, a: str, b: str, pattern: str, slice_size: int = SLICE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every text."""
    spark = docs.sparkSession
    rows, width = aligned(docs, a, b, pattern)
    rows, path = stage_at(rows)
    counts, counts_path = stage_at(pair_counts(rows, width))
    slices = max(1, -(-counts.count() // slice_size))
    for i in range(slices):
        part = counts.where(F.pmod(F.xxhash64("pair"), F.lit(slices)) == i).toArrow().sort_by("pair")
        sent = spark.sparkContext.broadcast(tuple(part.column(c).to_numpy() for c in ("pair", "n", "best")))  # about slice_size pairs
        more = map_rows(rows, _summed(sent), rows.schema)
        if i + 1 < slices:
            more, more_path = stage_at(more)
            unstage(spark, path)
            path = more_path
        rows = more
    unstage(spark, counts_path)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@lru_cache(maxsize=1)
def public_files() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN


def query(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), *public_files())
