"""The dependency graph of one repository, or one of its components, at a time in a task's memory.

Rows come sorted by repository, so a task holds one of them. A repository of at most ``MOST_EDGES`` edges goes this way (names are
numbered in their order, edges are two numbers each); larger ones take the rounds of ``graph``. Searches for cycles are dealt out by the nodes
that they start at: a component is sent to a task for every ``CHUNK`` of its edges, to ``MOST_CHUNKS`` at most.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.functions.staging import stage

MOST_EDGES, CHUNK, MOST_CHUNKS = 8_000_000, 50_000, 64
#: Edges for each task of a pass, and rows that a task gives at a time.
TASK_EDGES, SEARCH_EDGES, OUT_ROWS = 100_000, 12_500, 10_000


def _tasks(spark, rows: int, each: int) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def split(edges: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """Of staged edges those of repositories that fit into a task, those of others (None without any), and how many the first are. Few
    repositories are large, so their ids come to the driver."""
    counts = edges.where("repo_id is not null").groupBy("repo_id").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    if total <= MOST_EDGES:
        return edges, None, total
    large = counts.where(F.col("n") > MOST_EDGES).collect()
    if not large:
        return edges, None, total
    is_large = F.col("repo_id").isin([r["repo_id"] for r in large])
    return edges.where(~is_large), edges.where(is_large), total - sum(r["n"] for r in large)


def _grouped(rows: DataFrame, keys: list[str], n: int, group: Callable, schema: str) -> DataFrame:
    """``group(key)`` for each key of rows: an object that takes the rows (``add``) and then gives tuples of the columns after repo_id (``rows``)."""
    shape = T.StructType([rows.schema["repo_id"], *T._parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(shape)

    def batches(repo, found: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(found, OUT_ROWS):
            columns = [[repo] * len(part), *zip(*part, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key = None, None
        for batch in given:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows - 1, bool)
            for k in keys:
                c = batch.column(k)
                change |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:]):
                own = tuple(batch.column(k)[a].as_py() for k in keys)
                if own != key:
                    if now is not None:
                        yield from batches(key[0], now.rows())
                    now, key = group(own), own
                now.add(batch.slice(a, b - a))
        if now is not None:
            yield from batches(key[0], now.rows())

    return rows.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, shape)


def _pieces(found: Iterable[tuple], n: int) -> Iterator[list[tuple]]:
    part: list[tuple] = []
    for row in found:
        part.append(row)
        if len(part) == n:
            yield part
            part = []
    if part:
        yield part


def _compact(numbers: np.ndarray) -> array:
    return array("i", numbers.astype(np.int32).tobytes())


def _lists(n: int, s: np.ndarray, t: np.ndarray) -> tuple[array, array]:
    """Of edges, sorted by s and t: where the targets of each node begin, and the targets."""
    return _compact(np.searchsorted(s, np.arange(n + 1))), _compact(t)


class _Named:
    """A repository's edges by numbers in the order of names. A row without dst names a file."""

    def __init__(self, key: tuple):
        self.ids: dict[str, int] = {}
        self.ends: tuple[list, list, list] = ([], [], [])

    def _numbers(self, column: pa.Array) -> np.ndarray:
        coded, ids = column.dictionary_encode(), self.ids
        own = np.array([ids.setdefault(name, len(ids)) for name in coded.dictionary.to_pylist()], np.int32)
        return own[coded.indices.to_numpy(zero_copy_only=False)]

    def add(self, batch: pa.RecordBatch) -> None:
        edge = pc.is_valid(batch.column("dst"))
        edges, files = batch.filter(edge), batch.filter(pc.invert(edge))
        for at, column in enumerate((edges.column("src"), edges.column("dst"), files.column("src"))):
            if len(column):
                self.ends[at].append(self._numbers(column))

    def numbered(self) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Names in order; s and t of the distinct edges, sorted; files, as often as they were named."""
        names = sorted(self.ids)
        rank = np.empty(len(names), np.int64)
        rank[np.fromiter((self.ids[x] for x in names), np.int64, len(names))] = np.arange(len(names))
        self.ids = {}
        s, t, files = (rank[np.concatenate(x)] if x else np.zeros(0, np.int64) for x in self.ends)
        self.ends = ([], [], [])
        both = np.unique(s * len(names) + t)
        return names, both // max(1, len(names)), both % max(1, len(names)), files


def _components(n: int, start: array, to: array) -> np.ndarray:
    """For each node the least node of its strongly connected component (Tarjan's search, without recursion)."""
    seen, low, of, count = array("i", bytes(4 * n)), array("i", bytes(4 * n)), array("i", bytes(4 * n)), 0
    for root in range(n):
        if seen[root]:
            continue
        count += 1
        seen[root] = low[root] = count
        held, way, left = [root], [root], [iter(to[start[root] : start[root + 1]])]
        while way:
            at = way[-1]
            for x in left[-1]:
                if not seen[x]:
                    count += 1
                    seen[x] = low[x] = count
                    held.append(x)
                    way.append(x)
                    left.append(iter(to[start[x] : start[x + 1]]))
                    break
                if not of[x] and seen[x] < low[at]:
                    low[at] = seen[x]
            else:
                way.pop()
                left.pop()
                if way and low[at] < low[way[-1]]:
                    low[way[-1]] = low[at]
                if low[at] == seen[at]:
                    first = len(held) - 1
                    while held[first] != at:
                        first -= 1
                    own = held[first:]
                    del held[first:]
                    label = min(own) + 1
                    for x in own:
                        of[x] = label
    return np.frombuffer(of, np.int32).astype(np.int64) - 1 if n else np.zeros(0, np.int64)


class _Members(_Named):
    """path, component (the least name) and size of the files on cycles."""

    def rows(self) -> Iterator[tuple]:
        names, s, t, _ = self.numbered()
        of = _components(len(names), *_lists(len(names), s, t))
        size = np.bincount(of, minlength=len(names))[of]
        for x in np.flatnonzero(size > 1).tolist():
            yield names[x], names[of[x]], int(size[x])


class _Inside(_Named):
    """component (a number), path, s, t: the files of components of two or more (s: their place in it by name) and the edges within
    (s, t: places); edges: how many edges the component has."""

    def rows(self) -> Iterator[tuple]:
        names, s, t, _ = self.numbered()
        of = _components(len(names), *_lists(len(names), s, t))
        size = np.bincount(of, minlength=len(names))
        inside = of[s] == of[t]
        s, t = s[inside], t[inside]
        edges = np.bincount(of[s], minlength=len(names))
        order = np.argsort(of, kind="stable")
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names)) - np.concatenate(([0], np.cumsum(size)))[of[order]]
        for x in np.flatnonzero(size[of] > 1).tolist():
            yield int(of[x]), int(edges[of[x]]), int(place[x]), None, names[x]
        for a in range(0, len(s), OUT_ROWS):
            own = slice(a, a + OUT_ROWS)
            c = of[s[own]]
            yield from zip(c.tolist(), edges[c].tolist(), place[s[own]].tolist(), place[t[own]].tolist(), [None] * len(c))


class _Depths(_Named):
    """path and depth of the files that were named, as often as they were (see graph.topological_layers)."""

    def rows(self) -> Iterator[tuple]:
        names, s, t, files = self.numbered()
        n = len(names)
        known = np.zeros(n, bool)
        known[files] = True
        back = np.lexsort((s, t))
        start, importers = _lists(n, t[back], s[back])
        open_, depth = _compact(np.bincount(s, minlength=n)), array("i", bytes(4 * n))
        now = np.flatnonzero(known & (np.bincount(s, minlength=n) == 0)).tolist()
        known = bytearray(known.tobytes())
        while now:
            after = []
            for x in now:
                for y in importers[start[x] : start[x + 1]]:
                    depth[y] = depth[x] + 1  # of the deepest, which comes last
                    open_[y] -= 1
                    if not open_[y] and known[y]:
                        after.append(y)
            now = after
        for x in files.tolist():
            yield names[x], None if open_[x] else depth[x]


def members(edges: DataFrame, count: int) -> DataFrame:
    """repo_id, path, component, size."""
    return _grouped(_own(edges), ["repo_id"], _tasks(edges.sparkSession, count, TASK_EDGES), _Members, "path string, component string, size long")


def depths(nodes: DataFrame, edges: DataFrame, count: int) -> DataFrame:
    """repo_id, path, depth of all nodes with both."""
    files = nodes.where("repo_id is not null and path is not null").select("repo_id", F.col("path").alias("src"), F.lit(None).cast("string").alias("dst"))
    return _grouped(files.unionByName(_own(edges)), ["repo_id"], _tasks(edges.sparkSession, count, TASK_EDGES), _Depths, "path string, depth int")


def components(edges: DataFrame, count: int) -> DataFrame:
    """A staged table of what is within components (see _Inside)."""
    return stage(_grouped(_own(edges), ["repo_id"], _tasks(edges.sparkSession, count, TASK_EDGES), _Inside, "component long, edges long, s long, t long, path string"))


def _own(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst and repo_id is not null").select("repo_id", "src", "dst")


class _Component:
    """A component, and which part of its searches is this task's."""

    def __init__(self, key: tuple):
        self.turn, self.of, self.parts = key[2], 1, []

    def add(self, batch: pa.RecordBatch) -> None:
        self.of = batch.column("chunks")[0].as_py()
        self.parts.append(batch.select(["s", "t", "path"]))

    def load(self) -> None:
        table = pa.Table.from_batches(self.parts)
        self.parts = []
        edge = pc.is_valid(table["t"])
        files, edges = table.filter(pc.invert(edge)), table.filter(edge)
        names = dict(zip(files["s"].to_pylist(), files["path"].to_pylist()))
        self.names = [names[i] for i in range(len(names))]
        s, t = edges["s"].to_numpy(), edges["t"].to_numpy()
        order = np.lexsort((t, s))
        self.start, self.to = _lists(len(names), s[order], t[order])
        order = np.lexsort((s, t))
        self.start_back, self.from_ = _lists(len(names), t[order], s[order])

    def said(self, cycle: list[int]) -> str:
        return " > ".join([self.names[x] for x in cycle])


class _Shortest(_Component):
    """cycle, size, component (its least file): for every edge the shortest cycle through it, of several the one with the least names from the edge on.

    From the end t of edges a search goes forward, which all edges to t share: it meets nodes in the order of the least ways to them. From
    the other end s one goes backward; the one with the smaller frontier takes the next step, until they meet."""

    def rows(self) -> Iterator[tuple]:
        self.load()
        start, to, start_back, from_ = self.start, self.to, self.start_back, self.from_
        found: set[tuple[int, ...]] = set()
        for t in range(self.turn, len(self.names), self.of):
            ahead, before, front, a = {t: 0}, {}, [t], 0
            for s in from_[start_back[t] : start_back[t + 1]]:
                back, rear, b, met = {s: 0}, [s], 0, s if s in ahead else None
                while met is None:
                    if len(rear) <= len(front):
                        b, after = b + 1, []
                        for x in rear:
                            for y in from_[start_back[x] : start_back[x + 1]]:
                                if y not in back:
                                    back[y] = b
                                    after.append(y)
                        rear = after
                        hit = any(ahead.get(y) == a for y in rear)
                    else:
                        a, after = a + 1, []
                        for x in front:
                            for y in to[start[x] : start[x + 1]]:
                                if y not in ahead:
                                    ahead[y] = a
                                    before[y] = x
                                    after.append(y)
                        front = after
                        hit = any(back.get(y) == b for y in front)
                    if hit:
                        met = next(y for y in front if back.get(y) == b)
                way = [met]
                while way[-1] != t:
                    way.append(before[way[-1]])
                way.reverse()
                while way[-1] != s:
                    b -= 1
                    way.append(next(y for y in to[start[way[-1]] : start[way[-1] + 1]] if back.get(y) == b))
                k = way.index(min(way))
                found.add((*way[k:], *way[:k]))
        for cycle in found:
            yield self.said(cycle), len(cycle), self.names[0]


def _short(most: int) -> type:
    class Short(_Component):
        """cycle, size: all simple cycles of at most ``most`` nodes, from their least node on."""

        def rows(self) -> Iterator[tuple]:
            self.load()
            start, to = self.start, self.to
            for s in range(self.turn, len(self.names), self.of):
                ends = {x for x in self.from_[self.start_back[s] : self.start_back[s + 1]] if x > s}
                ways = [(s,)] if ends and most > 1 else []
                while ways:
                    way = ways.pop()
                    near = to[start[way[-1]] : start[way[-1] + 1]]
                    for y in ends.intersection(near).difference(way):
                        yield self.said((*way, y)), len(way) + 1
                    if len(way) + 2 <= most:
                        ways += [(*way, y) for y in near if y > s and y not in way]

    return Short


def members_of(parts: DataFrame) -> DataFrame:
    """repo_id, path, component (its least file), size of ``components``."""
    files = parts.where("t is null").select("repo_id", "component", "path")
    named = files.groupBy("repo_id", "component").agg(F.min("path").alias("least"), F.count("*").alias("size"))
    return files.join(named, ["repo_id", "component"]).select("repo_id", "path", F.col("least").alias("component"), "size")


def _searched(parts: DataFrame, search: type, schema: str) -> DataFrame:
    spark = parts.sparkSession
    count = parts.agg(F.count("t")).first()[0]
    chunks = F.least(F.lit(MOST_CHUNKS), F.greatest(F.lit(1), F.ceil(F.col("edges") / CHUNK))).cast("int")
    dealt = parts.withColumn("chunks", chunks).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return _grouped(dealt, ["repo_id", "component", "chunk"], _tasks(spark, count, SEARCH_EDGES), search, schema)


def shortest_cycles(parts: DataFrame) -> DataFrame:
    """repo_id, cycle, size, component of ``components``; a cycle over edges of several tasks is kept once."""
    return _searched(parts, _Shortest, "cycle string, size int, component string").distinct()


def short_cycles(parts: DataFrame, most: int) -> DataFrame:
    """repo_id, cycle, size of ``components``."""
    return _searched(parts, _short(most), "cycle string, size int")
