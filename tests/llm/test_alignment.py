from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from tests.llm.edges import edge_docs, no_docs

from corpusloom.llm import alignment

TEXTS = [
    "plain words of a text", "plain words and others, e.g. naïve façade", "", None, " ", "   ", "a  b\n  c\n\n d \t e ", "trailing  ", "\n", "\n x", "x\n", "<s> </s> <unk> <0x41> <|endoftext|>", "▁ ▁▁x ▁",
    "中文 字符 🙂🙂 é ́", "\x00\x01 \x85  z", "a" * 3000 + " " * 50 + "bc" * 2000, "1234567890 12.5e-7", "ab cd " * 400, "plain words of a text", "　x   y", "ﬁ ½ Ａ", "it's I'll 'S don't", "the the the The", "cafés' �",
]


def brute(texts):
    """Both libraries over whole texts, and offsets."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path, _ = alignment.public_files()
    a_side = Tokenizer.from_file(a_path)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=b_path)
    letters = alignment.byte_letters()
    found, held = [], []
    for text in texts:
        x = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b_side.encode(text) if text else []
        a = [bytes(letters[c] for c in a_side.id_to_token(i)) for i in x]
        b = [alignment.piece_bytes(b_side.id_to_piece(i)) for i in y]
        if not text or b"".join(a) != (" " + text).encode() or b"".join(b) != (" " + text).encode():
            found.append(None)
            continue
        ends = [set(), set()]
        for side, tokens in enumerate((a, b)):
            at = 0
            for t in tokens:
                at += len(t)
                ends[side].add(at)
        cuts, groups, i, j, at_a, at_b = sorted(ends[0] & ends[1]), [], 0, 0, 0, 0
        for cut in cuts:
            u, v = [], []
            while at_a < cut:
                u.append(x[i])
                at_a, i = at_a + len(a[i]), i + 1
            while at_b < cut:
                v.append(y[j])
                at_b, j = at_b + len(b[j]), j + 1
            groups.append((u, v))
        found.append((len(x), len(y), groups))
    counts = Counter()
    for f in found:
        counts.update({(u, v) for us, vs in f[2] for u in us for v in vs} if f else ())
    most = defaultdict(int)
    for (u, _), n in counts.items():
        most[u] = max(most[u], n)
    for f in found:
        if f is None:
            held.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(u, v) for us, vs in f[2] for u in us for v in vs]
        said = ";".join(f"{','.join(map(str, us))}|{','.join(map(str, vs))}" for us, vs in f[2])
        held.append((f[0], f[1], len(f[2]), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest()))
    return held


def run(spark, docs, **how):
    rows = alignment.align(docs, *alignment.public_files(), **how).collect()
    return [(r["doc_id"], *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in rows]


@pytest.mark.parametrize("slice_size", [alignment.SLICE, 100])
def test_equals_offsets_of_both_libraries(spark, slice_size):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, pairs string").repartition(3)
    assert sorted(run(spark, docs, slice_size=slice_size)) == [(i, *w) for i, w in enumerate(brute(TEXTS))]


def test_given_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    assert sorted(run(spark, docs)) == [(i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows]), strict=True)]


def test_edges(spark):
    docs = edge_docs(spark)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = [(i, *w) for (i, _), w in zip(texts, brute([t for _, t in texts]), strict=True)]
    assert sorted(run(spark, docs), key=str) == sorted(want, key=str)
    assert run(spark, no_docs(spark)) == []


def test_transducer():
    t = alignment.Transducer([b"ab", b"c", b"abc", b"x", b""], [b"a", b"bc", b"abcab", b"c", b"b"])
    said = lambda a, b: None if (found := t.groups(a, b)) is None else [text for text, _ in found]
    assert said([0, 1], [0, 1]) == ["0,1|0,1"]
    assert t.groups([0, 1], [0, 1])[0][1] == ((0, 0), (0, 1), (1, 0), (1, 1))
    assert said([0, 1, 0, 1], [2, 3]) == ["0,1,0|2", "1|3"]
    assert said([0, 1], [0, 4, 3]) == ["0|0,4", "1|3"]
    assert said([0, 3], [0, 1]) is None and said([0], [0]) is None and said([], [0]) is None and said([0], []) is None
    assert said([], []) == []
    held = t.kept
    assert said([0, 1] * 50, [0, 1] * 50) == ["0,1|0,1"] * 50
    assert t.kept == held  # every transition and group was known


def test_packing():
    import numpy as np

    for values in ([], [0], [1, 2**31, 2**32 - 1]):
        assert alignment.unpack(alignment.pack(np.array(values, dtype=np.int64))).tolist() == values
