from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import flac, graphs, neighbours, ngram_join, url_filter


def test_url_classes(spark):
    rows = [
        (1, "http://www.a.example.org/es/x", None), (2, "https://b.example.net/en", '<link rel="canonical" href="http://a.example.org/es/x">'),
        (3, "https://c.example.net/", '<meta http-equiv="refresh" content="0; url=https://b.example.net/en">'), (4, "https://d.example.net/q?utm_source=z#t", ""),
        (5, None, None), (6, "no scheme", "<p>"), (7, "http://X.example.com/fr/1", '<link rel=canonical href="https://e.example.net/z">'),
        (8, "https://e.example.net/z/", None), (9, "http://example.com/de/", '<link rel=canonical href="https://e.example.net/z">'), (4, "https://d.example.net/q?utm_source=z#t", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS verdict")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages).collect()}
    assert url_filter.filter_urls(pages).count() == len(rows)
    assert got[1]["verdict"] == "block" and got[1]["rule"] == "example.org/es/"
    assert got[2]["verdict"] == got[3]["verdict"] == "block" and got[3]["reason"] == "alias" and got[3]["rule"] is None
    assert got[4]["verdict"] == "allow" and got[5]["host"] == "" and got[6]["path"] == ""
    assert got[9]["verdict"] == "block" and got[8]["verdict"] == "allow" and got[8]["reason"] == "alias"
    redirects = spark.createDataFrame([("https://d.example.net/q", "http://a.example.org/es/x")], "src string, dst string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, redirects=redirects).collect()}[4] == "block"
    assert url_filter.filter_urls(pages.limit(0)).collect() == []


def test_url_targets_are_resolved(spark):
    base = "https://h.example.net/a/b?q#f"
    targets = {
        "http://x.com/de/1": "http://x.com/de/1", "//x.com/de/1": "https://x.com/de/1", "/de/1": "https://h.example.net/de/1", "c": "https://h.example.net/a/c",
        "../c/./d?x=../y": "https://h.example.net/c/d?x=../y", "../../..": "https://h.example.net/", "?p=2": "https://h.example.net/a/b?p=2", ".": "https://h.example.net/a/",
        "go?u=http://x.com/": "https://h.example.net/a/go?u=http://x.com/", "#top": None, "": None, "mailto:a@b.c": None,
    }
    rows = spark.createDataFrame([(t, base) for t in targets], "target string, base string")
    assert {r[0]: r[1] for r in rows.select("target", url_filter.resolve(rows.target, rows.base)).collect()} == targets
    assert spark.createDataFrame([("c", "http://h")], "t string, b string").select(url_filter.resolve(F.col("t"), F.col("b"))).first()[0] == "http://h/c"


def test_url_classes_over_relative_links_and_embedded_addresses(spark):
    refresh = '<meta http-equiv="refresh" content={}>'
    rows = [
        (1, "http://x.com/a", '<link rel="canonical" href="/de/5">'), (2, "http://y.example.net/", "<link rel=canonical href=//x.com/de/6>"),
        (3, "http://x.com/b/", refresh.format('"0; url=../de/7"')), (4, "http://y.example.net/4", refresh.format("\"0; url='http://x.com/de/8'\"")),
        (5, "http://y.example.net/5", refresh.format("'0; URL=\"http://x.com/de/9\"'")), (6, "http://y.example.net/6", refresh.format('"0; url=" name="http://x.com/de/1"')),
        (7, "http://proxy.net/go?u=http://x.com/de/1", None), (8, "http://y.example.net/8", '<base href="http://x.com/"><link rel=canonical href="de/2">'),
        (9, "http://y.example.net/9", None), (10, "http://y.example.net/10", refresh.format("0;url=http://x.com/de/3")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://x.com/de/4", "/f"), ("http://y.example.net/9", "//x.com/f")], "src string, dst string")
    got = {r["page_id"]: (r["verdict"], r["reason"]) for r in url_filter.filter_urls(pages, redirects=redirects).collect()}
    assert got == {i: ("allow", "default") if i in (6, 7) else ("block", "alias") for i in range(1, 11)}


def least_ids(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(random.Random(4).randrange(90), i) for i in range(90)], []])
def test_components(spark, edges):
    got = graphs.components(spark.createDataFrame(edges, "u long, v long"))
    assert {r["node"]: r["component"] for r in got.collect()} == least_ids([e for e in edges if e[0] != e[1]])


def copies(seed, groups, members, words, changes):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(words)]
        for _ in range(members):
            own = list(base)
            for _ in range(r.randrange(changes + 1)):
                own[r.randrange(words)] = r.choice(vocabulary)
            texts.append(" ".join(own))
    return texts


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_classes(texts, n=3, percent=90):
    sets = [shingles(t, n) for t in texts]
    edges = [(i, i) for i in range(len(texts))]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                edges.append((i, j))
    return least_ids(edges)


@pytest.mark.parametrize(("most", "n", "percent"), [(1000, 3, 90), (7, 3, 90), (1000, 5, 80)])
def test_ngram_join_against_all_pairs(spark, monkeypatch, most, n, percent):
    """most=7: every group is cut into chunks, so both rounds run."""
    monkeypatch.setattr(ngram_join, "MOST_SETS", most)
    monkeypatch.setattr(ngram_join, "MOST_MAPS", most)
    monkeypatch.setattr(ngram_join, "COMMON", 2 if most == 7 else 16)
    texts = copies(1, 4, 14, 120, 5) + copies(2, 10, 2, 30, 1) + copies(3, 6, 3, 9, 1) + ["a b", "A  b", "a", "", None, "x y z"] + copies(4, 1, 30, 200, 9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_classes(docs, n, percent).collect()}
    assert got == brute_classes(texts, n, percent)
    if n == 3:
        kept = [r["doc_id"] for r in ngram_join.keep_one(docs.union(docs.where("doc_id = 0")), n, percent).collect()]
        assert sorted(kept) == sorted(set(got.values()))


def test_keep_one_of_equal_ids_and_odd_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (1, "totally other words here"), (2, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (None, "alpha beta gamma delta")], "doc_id long, text string")
    odd = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(("fp", "turn", "turn_", "b_", "bucket", "gone_id"))), F.create_map(F.lit("k"), F.lit(1)).alias("m"))
    got = ngram_join.keep_one(odd)
    assert got.columns == odd.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == [("1", "alpha beta gamma delta"), ("1", "totally other words here"), ("None", "alpha beta gamma delta")]


def test_sets_list_few_edges_and_linked_ones_meet_at_one():
    """As many differences as a link allows, one in each of the parts that a set lists first: the worst case."""
    rng = np.random.default_rng(3)
    for percent, most_listed in ((80, 0.44), (90, 0.2)):
        ladder = ngram_join.Ladder(percent)
        listed = grams = 0
        for size in [*range(4, 60), *rng.integers(60, 2500, 100).tolist()]:
            a = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
            for grown in (False, True):
                # a larger set has grams more; one of equal size has grams of its own instead of some of these
                most = max(d for d in range(size) if 100 * (size if grown else size - d) >= percent * (size + d))
                c = ladder.classes(size)[-1] if ladder.classes(size) else None
                if not most or c is None:
                    continue
                ends = ladder.ends(c)[:most]
                extra = (ends - np.arange(most, dtype=np.uint64) * np.uint64(7919) % np.uint64(1000003))
                lost = np.unique(np.minimum(np.searchsorted(a, ends), size - 1))[:most]
                b = np.union1d(a if grown else np.delete(a, lost), extra[: most if grown else len(lost)])
                shared = len(np.intersect1d(a, b))
                assert 100 * shared >= percent * (len(a) + len(b) - shared)
                x, y = ladder.edges(a), ladder.edges(b)
                assert len(np.intersect1d(x, y)), (percent, size, grown)
                listed, grams = listed + len(x), grams + len(a)
        assert listed < most_listed * grams


def test_edges_are_dealt_to_rounds():
    texts = [" ".join(f"w{i * i % 997}" for i in range(k, k + 300)) for k in (0, 10)]
    got = ngram_join._describe(5, 80)({"doc_id": [0, 1, 2], "fp": [0, 1, 2], "text": [*texts, texts[0]]})
    rounds = [got[f"edges_{i}"] for i in range(ngram_join.ROUNDS)]
    every = [np.concatenate([of_round[k] for of_round in rounds]) for k in range(3)]
    for k in range(2):
        assert sorted(every[k]) == sorted(ngram_join.Ladder(80).edges(ngram_join.gram_set(texts[k], 5)).astype(np.int64))
        assert max(len(of_round[k]) for of_round in rounds) < 0.5 * len(every[k])
    assert len(every[2]) == 0
    assert not any(set(a[0]) & set(b[1]) for i, a in enumerate(rounds) for j, b in enumerate(rounds) if i != j)


def test_bitmaps_never_part_what_links():
    texts = sorted(set(copies(8, 2, 60, 90, 12) + copies(9, 1, 40, 300, 40)))
    sets = [ngram_join.gram_set(t, 5) for t in texts]
    group = np.arange(len(sets))
    ngram_join.join_maps([ngram_join.bitmap(s) for s in sets], np.array([len(s) for s in sets]), group, 80, np.ones(len(sets), dtype=bool))
    want = brute_classes(texts, 5, 80)
    assert all(group[i] == group[j] for i in range(len(sets)) for j in range(i) if want[i] == want[j])
    assert len(set(group.tolist())) > 1


def test_a_group_that_links_as_a_whole_is_walked_by_its_tree(monkeypatch):
    walked = []
    real = ngram_join.join_tree
    monkeypatch.setattr(ngram_join, "join_tree", lambda sets, *more: walked.append(len(sets)) or real(sets, *more))
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 62, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([np.delete(base, rng.integers(0, len(base), 3)), rng.integers(0, 1 << 62, 2).astype(np.uint64)])) for _ in range(40)]
    sets += [np.unique(rng.integers(0, 1 << 62, 190).astype(np.uint64)) for _ in range(5)]
    links = ngram_join._set_links(90)([(i, True, None, s.tobytes()) for i, s in enumerate(sets)])
    assert walked == [45] and {x for link in links for x in link} == set(range(40)) and len(links) == 39


def test_tree_walk_finds_all_links():
    texts = sorted(set(copies(5, 3, 20, 80, 4)))
    sets = [ngram_join.gram_set(t, 3) for t in texts]
    group = np.arange(len(sets))
    ngram_join.join_tree(sets, group, 90)
    want = brute_classes(texts)
    assert all((group[i] == group[j]) == (want[i] == want[j]) for i in range(len(sets)) for j in range(i))


def vectors(spark, n=900, seed=0):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, 16)).astype(np.float32)
    x[100:300] = x[100] + r.standard_normal((200, 16)).astype(np.float32) * 0.01
    x[400:440] = x[400]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(5000, None, 0), (5100, [0.0] * 16, 0), (5200, [float("nan")] * 16, 0), (5300, [None] + [1.0] * 15, 0), (5400, [1.0], 0), (None, [1.0] * 16, 0), rows[7], rows[400]]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>, key int")


def test_neighbours_within_one_window_are_exact(spark):
    x, table = vectors(spark)
    got = {}
    for r in neighbours.search(table, 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 900, 100))
    for q, rows in got.items():
        d = neighbours.distances(x[[q]].astype(float), x.astype(float))
        order = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        assert [v for _, v, _ in sorted(rows)] == order and all(s == d[v] for _, v, s in rows)
    assert neighbours.search(table.limit(0)).collect() == []
    few = neighbours.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in few] == [(0, 1, 1, 1.0)]


def recall(x, found, queries, k=10):
    hits = 0
    for q in queries:
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(found.get(q, set()) & set(np.argsort(d, kind="stable")[:k].tolist()))
    return hits / k / len(queries)


@pytest.mark.parametrize(("structured", "window", "partitions"), [(True, 128, 3), (False, 1024, 7)])
def test_neighbours_recall_over_windows(spark, structured, window, partitions):
    """Windows much smaller than the table and range partitions whose borders cut them: vectors in clusters, and without any structure
    (64 dimensions, the nearest at 0.7 of the mean distance)."""
    r = np.random.default_rng(3)
    if structured:
        x = (r.standard_normal((100, 64))[r.integers(0, 100, 4000)] + r.standard_normal((4000, 64)) * 0.2).astype(np.float32)
    else:
        x = r.standard_normal((4000, 64)).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(partitions)
    found = {}
    for row in neighbours.search(table, window=window).collect():
        found.setdefault(row["query_id"], set()).add(row["vec_id"])
    assert recall(x.astype(float), found, list(range(0, 4000, 100))) >= 0.9


def test_hilbert_neighbours_share_an_edge():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    path = cells[np.argsort(neighbours.hilbert_keys(cells, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [value >> (width - 1 - i) & 1 for i in range(width)]

    def rice(self, value, k):
        folded = value << 1 if value >= 0 else -value * 2 - 1
        self.bits += [0] * (folded >> k) + [1]
        self.put(folded & (1 << k) - 1, k)


def stream_of(samples, subframe):
    """A stream of one frame around a subframe written by hand."""
    import hashlib
    import struct

    head = b"\xff\xf8\x74\x02" + flac._coded_number(0) + struct.pack(">H", len(samples) - 1)
    head += bytes([flac.crc8(head)])
    w = Writer()
    subframe(w)
    w.bits += [0] * (-len(w.bits) % 8)
    frame = head + np.packbits(w.bits).tobytes()
    frame += struct.pack(">H", int(flac.crc16_rows(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]))
    info = struct.pack(">HH", len(samples), len(samples)) + bytes(6) + (8000 << 44 | 7 << 36 | len(samples)).to_bytes(8, "big")
    info += hashlib.md5(np.array(samples, dtype=np.int8).tobytes()).digest()
    return b"fLaC" + struct.pack(">I", 0x80000000 | len(info)) + info + frame


def test_flac_reads_other_subframes():
    x = [3, 5, 8, 9, 9, 7, 4, 4, 5, 6, -8, -100, 90, 2, 0, 1]

    def fixed_two_partitions(w):
        w.put(0b001010 << 1, 8)
        w.put(x[0] & 255, 8)
        w.put(x[1] & 255, 8)
        w.put(1 << 4 | 1, 6)  # five-bit parameters, two partitions
        r = [x[i] - 2 * x[i - 1] + x[i - 2] for i in range(2, 16)]
        w.put(2, 5)
        for v in r[:6]:
            w.rice(v, 2)
        w.put(31, 5)  # escaped: ten bits each
        w.put(10, 5)
        for v in r[6:]:
            w.put(v & 1023, 10)

    def wasted_verbatim(w):
        w.put(0b000001 << 1 | 1, 8)
        w.put(0b01, 2)  # two wasted bits
        for v in y:
            w.put((v >> 2) & 63, 6)

    y = [4 * v for v in range(-8, 8)]
    (a, blocks), (b, _) = flac.decode_many([stream_of(x, fixed_two_partitions), stream_of(y, wasted_verbatim)])
    assert a.tolist() == x and b.tolist() == y and blocks == [(0, 16, 42)]


def test_flac_round_trip_and_checks(spark):
    r = random.Random(3)
    payloads = [bytes(64), b"a" * 640, bytes(r.randrange(256) for _ in range(5000)), ("lorem ipsum dolor " * 400).encode(), b"z" * 63 + b"y"]
    streams = flac.encode_many(payloads)
    for p, (x, blocks) in zip(payloads, flac.decode_many(streams), strict=True):
        assert (x + 128).astype(np.uint8).tobytes() == p and sum(n for _, n, _ in blocks) == len(p)
    broken = bytearray(streams[2])
    broken[-40] ^= 1
    with pytest.raises(flac.Broken):
        flac.decode_many([bytes(broken)])
    docs = spark.createDataFrame([(1, "text " * 300), (2, None)], "doc_id long, text string")
    media = flac.write_media(docs)
    parts = flac.pcm_blocks(media).orderBy("doc_id", "block").collect()
    assert b"".join(bytes(p["pcm"]) for p in parts if p["doc_id"] == 1)[:5] == bytes((b - 128) % 256 for b in b"text ")
    assert [p["first_sample"] for p in parts if p["doc_id"] == 1] == [0, 512, 1024]
    first, _, points = flac.metadata(bytes(media.where("doc_id = 1").first()["media"]))
    assert [p[0] for p in points] == [0, 512, 1024] and [p["frame_offset"] - first for p in parts if p["doc_id"] == 1] == [p[1] for p in points]


def test_pipeline_against_brute_force(spark):
    import hashlib

    import public_tokenizers
    import tiktoken

    import corpus_pipeline as cp
    from corpusloom.llm import bpe, language, mixing

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r["doc_id"]: r for r in language.identify_languages(docs).collect()}
    kept = [r for r in docs.collect() if found[r["doc_id"]]["lang_pred"] != "und" and found[r["doc_id"]]["score"] >= cp.LEAST_SCORE]
    kept.sort(key=lambda r: r["doc_id"])
    classes = brute_classes([r["text"] for r in kept], 5, 80)
    kept = [r for i, r in enumerate(kept) if classes[i] == i]
    staged = spark.createDataFrame(kept, docs.schema)
    clean = cp.redact(spark, staged, "")
    copies_of = {r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect()}
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    known = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known.ranks, special_tokens={})
    want = []
    for i, text in texts.items():
        ids = own.encode_ordinary(text)
        row = (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        want += [row] * copies_of[i]
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in cp.run(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_take_awkward_rows(spark, stage):
    import corpus_pipeline as cp
    from tests.llm.edges import edge_docs, no_docs

    step = cp.STAGES[stage][1]
    out = step(spark, edge_docs(spark), "")
    assert out.count() > 0
    if stage < 4:
        assert out.columns == edge_docs(spark).columns
    assert step(spark, no_docs(spark), "").count() == 0


def test_flac_query_columns_against_plain_hashing(spark):
    import hashlib
    import zlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    media = flac.write_media(docs).cache()
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.collect()}
    pcm = {}
    for r in flac.pcm_blocks(media).orderBy("doc_id", "block").collect():
        assert r["first_sample"] == len(pcm.get(r["doc_id"], b""))
        pcm[r["doc_id"]] = pcm.get(r["doc_id"], b"") + bytes(r["pcm"])
    for r in flac.query(spark, "/root/testdata/sf0.001").collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["media_bytes"] == len(stored[r["doc_id"]]) and r["media_sha256"] == hashlib.sha256(stored[r["doc_id"]]).hexdigest()
        assert bytes((b + 128) % 256 for b in pcm[r["doc_id"]]) == payload
        samples = [b - 128 for b in payload]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:]))
        assert r["feature"] == f"peak={max(map(abs, samples))};power={sum(x * x for x in samples) // len(samples)};crossings={crossings};silent={samples.count(-128)}"
