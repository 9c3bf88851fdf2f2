"""N-gram Jaccard join with prefix trees.

A document is the set of its distinct word n-grams, in one global order (that of their 64-bit hashes). Sets that link differ in
few places: with J >= t, sets of a and b elements differ in at most (a + b)(1 - t)/(1 + t). So the order is cut into more
parts than that, and two linked sets agree on all of at least one part. A prefix tree whose paths begin at that part then
holds both below one first edge. Spark sorts these first edges (part and the run of n-grams in it, for a ladder of size
classes) in one shuffle of narrow rows, and keeps those that hold two different sets.

Below a first edge, sets are told apart by parity bitmaps: each n-gram flips one bit, so two sets differ in at least as many
n-grams as their bitmaps differ in bits, and a pair that exceeds what its sizes allow is no link. What may still link forms
clusters. In a cluster the sets stand in a prefix tree, and each set walks it: partial overlaps are shared by all sets below
a node, and a subtree is left as soon as the differences so far exceed what the sizes below allow. Sets that are joined
already are passed over, so a group of near copies costs about one comparison a set, and only links that join something come
out.

No group is held whole when it is large: the sets below a first edge and those of a cluster are cut into chunks, which first
meet a few common sets each; what isn't joined then meets all others, two parts at a time. No set is dropped or capped.

Equal sets are one node from the start, named by a 64-bit hash of the set (for ten billion documents a few pairs of
different sets would be expected to share one).

Defined cases: a null text, or one without words, has size 0 and is a class of its own; fewer than n words are one n-gram; rows
with equal ids and texts are in one class; a row with a null id is in the class of documents with its very set and has no other
links, and a class of null ids has a null name; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.staging import stage, stage_at, unstage
from corpusloom.llm.graphs import components
from corpusloom.llm.sieve import fresh, maybe, others
from corpusloom.llm.texts import holds, map_rows, pieces

#: Sets and n-grams that a group holds at most; sets that all chunks of a large group meet.
MOST_SETS, MOST_GRAMS, COMMON = 2000, 2_000_000, 16
#: The same for groups of bitmaps: sets, and n-grams of the sets that the bitmaps stand for.
MOST_MAPS, MOST_MAPPED = 10_000, 30_000_000

#: Groups of so many bitmaps are compared one by one, larger ones as a matrix.
FEW = 12

#: A part whose run has fewer n-grams is weak: chance, or a passage that many texts share, makes such runs equal.
STRONG = 3
#: Different sets that a task remembers, so as to list the edges of copies once.
SEEN = 100_000
#: Edges are told apart in so many rounds, each with its share of them, so that the disk holds the shuffle of one share at a time.
ROUNDS = 4

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


_WORDS: dict[bytes, int] = {}
WORDS_KEPT, LONGEST_KEPT = 200_000, 40


def gram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams; words end at ASCII white space, A-Z are lower-cased."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    known = _WORDS
    if len(known) > WORDS_KEPT:
        known.clear()
    hashes = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = xxhash.xxh3_64_intdigest(w)
            if len(w) <= LONGEST_KEPT:
                known[w] = h
        hashes.append(h)
    h = np.array(hashes, dtype=np.uint64)
    size = min(len(h), n)
    total = np.full(len(h) - size + 1, np.uint64(size), dtype=np.uint64)
    for i in range(size):
        total = mix(total * np.uint64(_ODD[i % len(_ODD)]) + h[i : len(h) - size + 1 + i])
    return np.unique(total)


def allowed(a, b, percent: int):
    """In how many n-grams linked sets of these sizes differ at most."""
    return (a + b) * (100 - percent) // (100 + percent)


def _below(mean: float, least: int) -> float:
    """How likely a part with so many n-grams on average has fewer than ``least``."""
    return sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(least))


class Ladder:
    """Size classes, each half as large again as the one before, and the parts of each for a threshold in percent."""

    def __init__(self, percent: int):
        self.percent = percent
        self.tops = [1]
        self.cuts: dict[int, tuple[int, int, int]] = {}
        self.bounds: dict[int, np.ndarray] = {}

    def reach(self, size: int) -> None:
        while self.tops[-1] < 200 * size // self.percent + 2:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * 3 // 2))

    def cut(self, c: int) -> tuple[int, int, int]:
        """Of a class: parts, how many of them may be weak, and the n-grams from which a run isn't weak. Linked sets agree on
        more parts than may be weak, so one of the others is among them."""
        found = self.cuts.get(c)
        if found is None:
            least = allowed(self.tops[c], self.tops[c], self.percent) + 1
            found = (least + min(3, 1 + least // 8), min(3, 1 + least // 8), 1)
            for strong in range(STRONG, 0, -1):
                slack = min(3, 1 + least // 8)
                while slack <= 3 + 0.3 * least:
                    weak = (least + slack) * _below(0.8 * self.tops[c] / (least + slack), strong)
                    if weak + 2 * math.sqrt(weak) <= slack:
                        break
                    slack += 1
                else:
                    continue
                found = (least + slack, slack, strong)
                break
            self.cuts[c] = found
        return found

    def classes(self, size: int) -> list[int]:
        """Each class that holds a set which can link to one of ``size`` and isn't smaller, if different sets in it can link."""
        self.reach(size)
        c = first = int(np.searchsorted(self.tops, size))
        found = []
        while c == first or 100 * size >= self.percent * (self.tops[c - 1] + 1):
            if allowed(self.tops[c], self.tops[c], self.percent):
                found.append(c)
            c += 1
        return found

    def needed(self, size: int, c: int) -> int:
        """How many parts of a class, from the first on, a set of ``size`` lists: more than it may differ in from any larger set of the
        class, and those that may be weak. Larger sets list no fewer, so two that link meet within the parts of the smaller one."""
        return allowed(size, min(self.tops[c], 100 * size // self.percent), self.percent) + 1 + self.cut(c)[1]

    def ends(self, c: int) -> np.ndarray:
        """The last hash of each part of a class."""
        found = self.bounds.get(c)
        if found is None:
            parts = self.cut(c)[0]
            found = self.bounds[c] = np.array([((i + 1) << 64) // parts - 1 for i in range(parts)], dtype=np.uint64)
        return found

    def edges(self, grams: np.ndarray) -> np.ndarray:
        """First edges of the prefix trees that begin at each part that the set lists: hashes of class, part and run."""
        mixed = mix(grams + np.uint64(1))
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        out = [np.zeros(0, dtype=np.uint64)]
        for c in self.classes(len(grams)):
            _, slack, strong = self.cut(c)
            parts = self.needed(len(grams), c)
            cuts = np.concatenate([[0], np.searchsorted(grams, self.ends(c)[:parts], side="right")])
            edges = mix(np.diff(sums[cuts]) ^ mix(np.arange(parts, dtype=np.uint64) + np.uint64((c + 1) << 32)))
            runs = np.diff(cuts)
            for least in range(strong, 0, -1):
                if int((runs < least).sum()) <= slack:
                    edges = edges[runs >= least]
                    break
            out.append(edges)
        return np.concatenate(out)


def bitmap(grams: np.ndarray) -> np.ndarray:
    """A bit for each value of the n-grams' low bits, set if an odd number of n-grams has it; one or two bits an n-gram (sets that share a
    half still differ in twice the bits that 80 % allow)."""
    bits = max(64, 1 << (len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little")


def name_of(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


# ---- bitmaps below a first edge


#: Words of bitmaps that a comparison of two blocks of sets holds.
BLOCK = 1 << 20


def join_maps(maps: list[np.ndarray], sizes: np.ndarray, group: np.ndarray, percent: int, walks: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of sets that may link and weren't joined before. group: a number per set, equal for joined sets; it is updated.
    walks: the sets that ask for the others; if all do, they ask for each other. Sets are compared block by block."""
    found: list[tuple[int, int]] = []
    among = bool(walks.all())
    lengths = np.array([len(m) for m in maps])
    for length in np.unique(lengths).tolist():
        # pairs meet in the smaller of both bitmaps: the larger one is folded
        own = np.flatnonzero(lengths == length)
        twice = np.flatnonzero(lengths == 2 * length)
        table = np.concatenate([np.stack([maps[i] for i in own.tolist()]), *([np.stack([maps[i][:length] ^ maps[i][length:] for i in twice.tolist()])] if len(twice) else [])])
        rows = np.concatenate([own[np.argsort(sizes[own], kind="stable")], twice[np.argsort(sizes[twice], kind="stable")]])
        order = np.concatenate([np.argsort(sizes[own], kind="stable"), len(own) + np.argsort(sizes[twice], kind="stable")])
        table, size = table[order].view(np.uint64), sizes[rows]
        width = max(1, int((BLOCK / table.shape[1]) ** 0.5))
        for low in range(0, len(own), width):
            a = slice(low, min(low + width, len(own)))
            for start in range(low, len(rows), width):
                b = slice(start, start + width)
                if 100 * size[a].max() < percent * size[b].min():
                    if start >= len(own):
                        break
                    continue
                apart = np.bitwise_count(table[a, None, :] ^ table[None, b, :]).sum(axis=2, dtype=np.int32)
                near = apart <= allowed(size[a, None], size[None, b], percent)
                if start == low:
                    near &= np.arange(near.shape[0])[:, None] < np.arange(near.shape[1])[None, :]
                if not among:
                    near &= walks[rows[a]][:, None] != walks[rows[b]][None, :]
                i, j = np.nonzero(near)
                i, j = rows[a][i], rows[b][j]
                while len(i):
                    # one pair of each set that isn't joined yet, then what is left
                    open_ = group[i] != group[j]
                    i, j = i[open_], j[open_]
                    for u, v in zip(*(x[np.unique(j, return_index=True)[1]].tolist() for x in (i, j)), strict=True):
                        if group[u] != group[v]:
                            group[group == group[v]] = group[u]
                            found.append((v, u))
    return found


# ---- the prefix tree


class Tree:
    """A compressed prefix tree over sets of ranks, its nodes in breadth-first order in arrays.

    Per node: its run of n-grams, its last n-gram, the depth at its end, the set that ends there (or -1), the bounds of the sizes
    below, its parent, and whether it has children."""

    def __init__(self, sets: list[np.ndarray]):
        rows = [s.tolist() for s in sets]
        order = sorted(range(len(rows)), key=rows.__getitem__)
        self.sizes = np.array([len(r) for r in rows])
        runs, last, depths, ends, parent, inner, ranges = [], [-1], [0], [-1], [0], [], [(0, len(order))]
        for low, high in ranges:  # grows while it is walked
            at = len(inner)
            depth = depths[at]
            if len(rows[order[low]]) == depth:
                ends[at] = order[low]
                low += 1
            inner.append(low < high)
            while low < high:
                first = rows[order[low]]
                top = low + 1
                while top < high and rows[order[top]][depth] == first[depth]:
                    top += 1
                close = rows[order[top - 1]]  # in sorted order the first and the last share what all share
                end, most = depth + 1, min(len(first), len(close))
                if top - low == 1:
                    end = len(first)
                while end < most and first[end] == close[end]:
                    end += 1
                runs.append(sets[order[low]][depth:end])
                last.append(first[end - 1])
                depths.append(end)
                ends.append(-1)
                parent.append(at)
                ranges.append((low, top))
                low = top
        self.last, self.depth, self.ends = np.array(last), np.array(depths), np.array(ends)
        self.inner = np.array(inner)
        sorted_sizes = np.append(self.sizes[order], 0)
        cuts = np.array(ranges).ravel()
        self.most = np.maximum.reduceat(sorted_sizes, cuts)[::2]
        self.least = np.minimum.reduceat(sorted_sizes, cuts)[::2]
        # levels: slices of nodes whose parents are in the level before, with their runs and where each begins in them
        every = np.concatenate(runs).astype(np.int32) if runs else np.zeros(0, dtype=np.int32)
        starts = np.concatenate([[0], np.cumsum([len(r) for r in runs], dtype=np.int64)])
        up = np.array(parent)
        self.levels, low, high = [], 0, 1
        while high < len(up):
            top = int(np.searchsorted(up, high, side="left"))
            a, b = int(starts[high - 1]), int(starts[top - 1])
            self.levels.append((high, top, up[high:top], every[a:b], starts[high - 1 : top - 1] - a))
            low, high = high, top


def join_tree(sets: list[np.ndarray], group: np.ndarray, percent: int, probes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of sets that link and weren't joined before. group: a number per set, equal for joined sets; it is updated.
    probes: the sets that walk the tree and ask for the others; if all do, they ask for each other. A set walks it level by level,
    all nodes of a level at once, and stops where no node is live."""
    if len(sets) < 2 or len(np.unique(group)) < 2:
        return []
    walks = np.ones(len(sets), dtype=bool)
    if probes is not None:
        walks[:] = False
        walks[probes] = True
    among = bool(walks.all())
    if among:  # one side of each pair asks, so the largest group needn't
        names, counts = np.unique(group, return_counts=True)
        walks = group != names[counts.argmax()]
    elif walks.sum() > len(sets) / 2:
        walks = ~walks
    grams, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    ranks = np.split(flat, np.cumsum(sizes)[:-1])
    tree = Tree(ranks)
    member = np.zeros(len(grams), dtype=np.uint8)
    ending = np.flatnonzero(tree.ends >= 0)
    common = np.zeros(len(tree.ends), dtype=np.int64)
    found: list[tuple[int, int]] = []
    for i in np.flatnonzero(walks).tolist():
        size = int(sizes[i])
        end = tree.ends[ending]
        useful = np.zeros(len(tree.ends), dtype=bool)
        useful[ending] = (group[end] != group[i]) & (~walks[end] | (among & (end < i)))
        live = (useful | tree.inner) & (100 * np.minimum(size, tree.most) >= percent * np.maximum(size, tree.least))
        member[ranks[i]] = 1
        passed = np.concatenate([[0], np.cumsum(member, dtype=np.int32)])[tree.last + 1]
        most = allowed(size, tree.most, percent)
        for low, high, parent, runs, starts in tree.levels:
            here = live[parent]
            if not here.any():
                live[low:] = False
                break
            shared = common[parent] + np.add.reduceat(member[runs], starts, dtype=np.int64)
            common[low:high] = shared
            # differences so far: n-grams of the path that the set lacks, and of the set that the path has passed
            apart = tree.depth[low:high] + passed[low:high] - 2 * shared
            live[low:high] &= here & (apart <= most[low:high])
        member[ranks[i]] = 0
        at = np.flatnonzero(live & useful)
        for node in at[100 * common[at] >= percent * (size + sizes[tree.ends[at]] - common[at])].tolist():
            j = int(tree.ends[node])
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                found.append((i, j))
    return found


# ---- the join on Spark

LINKS = "u long, v long"


def _describe(n: int, percent: int):
    ladder = Ladder(percent)
    seen: set[int] = set()

    def run(cols: dict[str, list]) -> dict[str, list]:
        holds("ngram_join", _WORDS.clear)
        sizes, names, maps, edges = [], [], [], [[] for _ in range(ROUNDS)]
        for text in cols["text"]:
            grams = gram_set(text, n)
            name = name_of(grams) if len(grams) else None
            sizes.append(len(grams))
            names.append(name)
            # of copies in a task one lists its edges, as long as the task remembers them
            if name is None or name in seen:
                maps.append(None)
                for of_round in edges:
                    of_round.append([])
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(name)
            maps.append(bitmap(grams).tobytes())
            listed = ladder.edges(grams)
            turns = listed % np.uint64(ROUNDS)
            for turn, of_round in enumerate(edges):
                of_round.append(listed[turns == turn].astype(np.int64))
        return {"doc_id": cols["doc_id"], "fp": cols["fp"], "n_shingles": sizes, "node": names, "bits": maps} | {f"edges_{i}": x for i, x in enumerate(edges)}

    return run


def _sets(n: int):
    def run(cols: dict[str, list]) -> dict[str, list]:
        holds("ngram_join", _WORDS.clear)
        sets = [gram_set(text, n) for text in cols["text"]]
        keep = [i for i, s in enumerate(sets) if len(s) and name_of(s) == cols["node"][i]]
        return {c: [cols[c][i] for i in keep] for c in cols if c != "text"} | {"grams": [sets[i].tobytes() for i in keep]}

    return run


#: Sets of a group that a row lists at most.
LISTED = 1000


def _shared_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows edge, node in order: a row for each edge with several nodes, with the list of its nodes (whole), or, where the list is long
    or may go on in another partition, rows with parts of it."""
    held_edge, held_node = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    opened = False  # whether a part of the held edge went out, or may stand in the partition before
    first = True

    def give(edge: np.ndarray, node: np.ndarray, last: bool) -> pa.RecordBatch:
        nonlocal first, opened
        starts = np.flatnonzero(np.concatenate([[True], edge[1:] != edge[:-1]]))
        counts = np.diff(np.append(starts, len(edge)))
        part = np.zeros(len(starts), dtype=bool)
        part[0] = first or opened
        part[-1] |= last
        out = (counts > 1) | part
        first = opened = False
        keep = np.repeat(out, counts)
        offsets = np.concatenate([[0], np.cumsum(counts[out])]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(edge[starts[out]]), pa.ListArray.from_arrays(offsets, pa.array(node[keep])), pa.array(~part[out])], names=["edge", "nodes", "whole"]
        )

    for batch in batches:
        edge, node = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in ((held_edge, "edge"), (held_node, "node")))
        fresh_ = np.concatenate([[True], (edge[1:] != edge[:-1]) | (node[1:] != node[:-1])]) if len(edge) else np.zeros(0, dtype=bool)
        edge, node = edge[fresh_], node[fresh_]
        if not len(edge):
            continue
        # the last edge of a batch may go on in the next one
        cut = int(np.searchsorted(edge, edge[-1])) if edge[0] != edge[-1] else 0
        if cut:
            yield give(edge[:cut], node[:cut], False)
        while len(edge) - cut > LISTED:  # of a long one the beginning needn't wait
            yield give(edge[cut : cut + LISTED], node[cut : cut + LISTED], True)
            cut, opened = cut + LISTED, True
        held_edge, held_node = edge[cut:], node[cut:]
    if len(held_edge):
        yield give(held_edge, held_node, True)


Rows = list[tuple]


def _map_links(percent: int):
    """Links that bitmaps allow within a group of rows node, probe, joined, size, bits."""

    def run(rows: Rows) -> list[tuple[int, int]]:
        nodes, group, probes, rest = _rows_of(rows)
        sizes = [x[0] for x in rest]
        if len(nodes) > FEW:
            return _named(nodes, join_maps([np.frombuffer(x[1], dtype=np.uint8) for x in rest], np.array(sizes), group, percent, probes))
        maps = [(8 * len(x[1]), int.from_bytes(x[1], "little")) for x in rest]
        found = []
        for i in range(len(nodes)):
            for j in range(i):
                if group[i] == group[j] or (probes[i] == probes[j] and not probes.all()) or 100 * min(sizes[i], sizes[j]) < percent * max(sizes[i], sizes[j]):
                    continue
                (p, x), (q, y) = sorted((maps[i], maps[j]))
                while q > p:
                    q //= 2
                    y = (y >> q) ^ (y & ((1 << q) - 1))
                if (x ^ y).bit_count() <= allowed(sizes[i], sizes[j], percent):
                    group[group == group[j]] = group[i]
                    found.append((i, j))
        return _named(nodes, found)

    return run


def _set_links(percent: int):
    """Links within a group of rows node, probe, joined, grams: its prefix tree decides them all."""

    def run(rows: Rows) -> list[tuple[int, int]]:
        nodes, group, probes, rest = _rows_of(rows)
        sets = [np.frombuffer(x[0], dtype=np.uint64) for x in rest]
        return _named(nodes, join_tree(sets, group, percent, np.flatnonzero(probes)))

    return run


def _rows_of(rows: Rows) -> tuple[list[int], np.ndarray, np.ndarray, list[tuple]]:
    """Of a group: the nodes in order, a number per node that is equal for joined ones, which nodes walk (one that came twice
    walks if either row says so), and the other columns."""
    by: dict[int, list] = {}
    for node, probe, *more in rows:
        old = by.get(node)
        by[node] = [probe or bool(old and old[0]), *more]
    nodes = sorted(by)
    first: dict[int, int] = {}
    group = np.array([i if (joined := by[node][1]) is None else first.setdefault(joined, i) for i, node in enumerate(nodes)])
    return nodes, group, np.array([by[node][0] for node in nodes], dtype=bool), [tuple(by[node][2:]) for node in nodes]


def _named(nodes: list[int], found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(nodes[a], nodes[b]) for a, b in found]


def by_group(rows: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...], run: Callable[[Rows], list[tuple[int, int]]]) -> DataFrame:
    """The pairs that ``run`` gives for each group. Groups are many and small: they stream through a task in order, which holds
    one at a time."""
    wanted = ("node", "probe", "joined", *columns)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Rows = []
        now = None
        for batch in batches:
            pairs: list[tuple[int, int]] = []
            for part in pieces(batch):
                key = list(zip(*(part.column(k).to_pylist() for k in keys), strict=True))
                values = list(zip(*(part.column(c).to_pylist() for c in wanted), strict=True))
                start = 0
                for i, k in enumerate(key):
                    if k != now:
                        held += values[start:i]
                        if len(held) > 1:
                            pairs += run(held)
                        held, start, now = [], i, k
                held += values[start:]
            yield _links(pairs)
        if len(held) > 1:
            yield _links(run(held))

    return rows.select(*keys, *wanted).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(stream, LINKS)


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["u", "v"])


def chunked(members: DataFrame, most_sets: int, most_grams: int) -> DataFrame:
    """cluster, m (its sets) and chunks of members(cluster, size), for clusters of two sets or more."""
    weight = members.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("size").alias("g")).where("m > 1")
    return weight.select("cluster", "m", F.greatest(F.ceil(F.col("m") / most_sets), F.ceil(F.col("g") / most_grams)).cast("int").alias("chunks"))


def linked(sets: DataFrame, members: DataFrame, columns: tuple[str, ...], run: Callable[[Rows], list[tuple[int, int]]]) -> DataFrame:
    """u, v: links that join the sets of each cluster. sets: rows node, cluster, m, chunks and the columns that ``run``
    needs; a set may stand in several clusters. members: the same without these columns, staged."""
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int")
    # the sets that all chunks of a cluster meet: about COMMON of them, by hash
    common = F.pmod(F.xxhash64("node", F.lit(2)), F.col("m")) < F.lit(COMMON)
    meets = F.when((F.col("chunks") > 1) & common, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own))
    dealt = sets.select("cluster", F.explode(meets).alias("chunk"), "node", *columns, F.lit(True).alias("probe"), F.lit(None).cast("long").alias("joined"))
    links = stage(by_group(dealt, ("cluster", "chunk"), columns, run))
    large = members.where("chunks > 1").select("node", "cluster", "chunks")
    if large.isEmpty():
        return links

    # In a large cluster, the rest is what isn't in its largest group. It is dealt into turns, and turns meet each other and the
    # chunks of the largest group, two parts at a time: a set goes to as many meetings as there are parts to meet.
    joined = components(links).withColumnRenamed("component", "joined")
    large = stage(large.join(joined, "node", "left").withColumn("joined", F.coalesce("joined", "node")))
    biggest = large.groupBy("cluster", "joined").agg(F.count("*").alias("c")).groupBy("cluster").agg(
        F.max(F.struct("c", "joined")).alias("top"), F.count("*").alias("groups"), F.sum("c").alias("m")
    )
    open_ = biggest.where("groups > 1").select("cluster", F.col("top.joined").alias("top"), (F.col("top.c") / F.col("m")).alias("share"))
    rest = large.join(open_, "cluster").withColumns(
        {
            "turns": F.ceil(F.col("chunks") * (1 - F.col("share"))).cast("int"),
            "stands": F.ceil(F.col("chunks") * F.col("share")).cast("int"),
        }
    )
    turn = F.pmod(F.xxhash64("node", F.lit(3)), F.col("turns")).cast("int")
    stand = F.pmod(F.xxhash64("node", F.lit(4)), F.col("stands")).cast("int")
    every = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    # (a, b): turns a <= b; (a, -1 - b): turn a and part b of the largest group
    among = F.transform(every("turns"), lambda t: F.struct(F.least(t, turn).alias("a"), F.greatest(t, turn).alias("b"), (t >= turn).alias("probe")))
    outward = F.transform(every("stands"), lambda c: F.struct(turn.alias("a"), (-1 - c).alias("b"), F.lit(True).alias("probe")))
    waiting = F.transform(every("turns"), lambda t: F.struct(t.alias("a"), (-1 - stand).alias("b"), F.lit(False).alias("probe")))
    places = F.when(F.col("joined") == F.col("top"), waiting).otherwise(F.concat(among, outward))
    plan = stage(rest.select("node", "cluster", "joined", places.alias("places")))
    if plan.isEmpty():
        return links
    meetings = sets.where("chunks > 1").select("node", "cluster", *columns).join(plan, ["node", "cluster"]).select("cluster", F.explode("places").alias("p"), "node", *columns, "joined")
    meetings = meetings.select("cluster", "p.a", "p.b", "p.probe", "node", *columns, "joined")
    return links.unionByName(stage(by_group(meetings, ("cluster", "a", "b"), columns, run)))


def _partitions(spark) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def described(docs: DataFrame, n: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """doc_id, fp (hash of the text), n_shingles, node (name of its set) for every document, and links u, v that join
    the nodes of each class."""
    spark = docs.sparkSession
    shape = "n_shingles long, node long, bits binary" + "".join(f", edges_{i} array<long>" for i in range(ROUNDS))
    shape = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType()), *T._parse_datatype_string(shape).fields])
    wide, wide_path = stage_at(map_rows(docs.select("doc_id", F.xxhash64("text").alias("fp"), "text"), _describe(n, percent), shape))
    # a shuffle of narrow rows, by ranges of both columns, so that an edge of many sets is dealt over several partitions
    staged = []
    for i in range(ROUNDS):
        ordered = wide.select(F.explode(f"edges_{i}").alias("edge"), "node").repartitionByRange(_partitions(spark), "edge", "node").sortWithinPartitions("edge", "node")
        staged.append(stage_at(ordered.mapInArrow(_shared_edges, "edge long, nodes array<long>, whole boolean")))
    shared = reduce(DataFrame.unionByName, [rows for rows, _ in staged])
    known = stage(wide.select("doc_id", "fp", "n_shingles", "node"))
    # copies with few changes meet at many edges: of those with the very same sets one is enough
    once = shared.where("whole").groupBy("nodes").agg(F.min("edge").alias("cluster")).select("cluster", F.explode("nodes").alias("node"))
    below = stage(once.unionByName(shared.where("not whole").select(F.col("edge").alias("cluster"), F.explode("nodes").alias("node"))).distinct())
    for _, path in staged:
        unstage(spark, path)
    wanted = below.select("node").distinct()
    maps = stage(wide.where("bits is not null").select("node", F.col("n_shingles").alias("size"), "bits").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("size").alias("size"), F.first("bits").alias("bits")))
    unstage(spark, wide_path)

    below = below.join(maps.select("node", "size"), "node")
    # few edges need chunks, and those with one set are none
    sized = stage(below.join(chunked(below, MOST_MAPS, MOST_MAPPED), "cluster").select("node", "cluster", "m", "chunks", "size"))
    near = stage(linked(sized.join(maps.select("node", "bits"), "node"), sized, ("size", "bits"), _map_links(percent)).distinct())
    clusters = stage(components(near).select("node", F.col("component").alias("cluster")))

    bearers = known.where("doc_id is not null").join(clusters, "node").groupBy("node", "cluster").agg(F.min(F.struct("doc_id", "fp")).alias("doc"), F.first("n_shingles").alias("size"))
    bearers = stage(bearers)
    fixed = stage(
        bearers.join(chunked(bearers, MOST_SETS, MOST_GRAMS), "cluster").select(F.col("doc.doc_id").alias("doc"), F.col("doc.fp").alias("print"), F.col("node").alias("name"), "cluster", "m", "chunks")
    )
    own = docs.select(F.col("doc_id"), F.xxhash64("text").alias("fp"), "text")
    texts = maybe(own, "doc_id", fixed, "doc").join(fixed, (F.col("doc_id") == F.col("doc")) & (F.col("fp") == F.col("print")))
    texts = texts.select(F.col("name").alias("node"), "cluster", "m", "chunks", "text")
    held = T._parse_datatype_string("node long, cluster long, m long, chunks int, grams binary")
    sets, sets_path = stage_at(map_rows(texts, _sets(n), held))
    links = linked(sets, fixed.withColumnRenamed("name", "node"), ("grams",), _set_links(percent))
    unstage(spark, sets_path)
    return known, links


def _classes(known: DataFrame, links: DataFrame) -> DataFrame:
    """known with class: equal for all nodes that links join."""
    return known.join(components(links), "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")


def jaccard_classes(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, node, component_id (least id of the class) for every document; sets link at J >= percent / 100."""
    rows = _classes(*described(docs, n, percent))
    least = rows.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "class", "left").select(
        "doc_id", "n_shingles", "node", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` with one document of each class: that with the class's least id, and of several such that with the least hash
    of its text. Documents without words and those without an id stay; of rows with equal ids and texts one stays (the
    first by its columns as JSON); rows with equal ids and different texts are different documents."""
    rows = stage(_classes(*described(docs, n, percent)).where(F.col("doc_id").isNotNull()))
    place = F.struct("doc_id", "fp")
    least = rows.where("n_shingles > 0").groupBy("class").agg(F.min(place).alias("least"))
    gone = stage(rows.join(least, "class").where(place != F.col("least")).select(F.col("doc_id").alias("gone_id"), F.col("fp").alias("gone_fp")).distinct())
    repeated = stage(rows.groupBy("doc_id", "fp").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias("gone_id"), F.col("fp").alias("gone_fp")))
    fp, turn = fresh(docs.columns, "fp"), fresh(docs.columns, "turn")
    own = docs.withColumn(fp, F.xxhash64("text"))

    def same(rows: DataFrame, keys: DataFrame):
        return (rows["doc_id"] == keys["gone_id"]) & (rows[fp] == keys["gone_fp"])

    doubtful = maybe(own, "doc_id", gone, "gone_id")
    left = others(own, "doc_id", gone, "gone_id").unionByName(doubtful.join(gone, same(doubtful, gone), "left_anti"))
    if repeated.isEmpty():
        return left.select(*docs.columns)
    once = left.join(repeated, same(left, repeated), "left_anti")
    first = Window.partitionBy("doc_id", fp).orderBy(F.to_json(F.struct(*docs.columns)))
    twice = left.join(repeated, same(left, repeated), "left_semi").withColumn(turn, F.row_number().over(first)).where(F.col(turn) == 1)
    return once.select(*docs.columns).unionByName(twice.select(*docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
alike AS (SELECT s, min(doc_id) AS doc_id, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s),
grams AS (SELECT doc_id, n, unnest(s) AS g FROM alike),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, a.n AS n, b.n AS m, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT u, v FROM pairs WHERE 100 * c >= 90 * (n + m - c)),
both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(u, v) AS (SELECT u, v FROM both_ways UNION SELECT r.u, l.v FROM reach r JOIN both_ways l ON r.v = l.u),
least_of AS (SELECT u, min(v) AS v FROM reach GROUP BY u),
named AS (SELECT s, least(doc_id, coalesce(v, doc_id)) AS component_id FROM alike LEFT JOIN least_of ON doc_id = u)
SELECT x.doc_id, len(x.s) AS n_shingles, coalesce(component_id, x.doc_id) AS component_id
FROM sets x LEFT JOIN named y ON list_sort(x.s) = y.s
"""
