"""The dependency graph: nodes(repo_id, path) and edges(repo_id, src, dst).

Components, cycles and layers of a repository that fits into a task are found there in one pass (see ``whole``). Others go in rounds,
which are written to the shared folder; one number a round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.staging import stage, stage_at, unstage
from corpusloom.operators import whole
from corpusloom.operators.catalog import LAYER_WORDS, LAYERS, PURPOSE_WORDS


def reverse_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct importers of each node, one row each."""
    known = nodes.select("repo_id", F.col("path").alias("dst"))
    return edges.join(known, ["repo_id", "dst"], "left_semi").select("repo_id", F.col("dst").alias("path"), F.col("src").alias("importer")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """imports and imported_by counts of every node, in one aggregation over both ends."""
    ends = edges.select("repo_id", F.col("src").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select("repo_id", F.col("dst").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    counts = ends.groupBy("repo_id", "path").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    zero = F.lit(0)
    return nodes.select("repo_id", "path").join(counts, ["repo_id", "path"], "left").select(
        "repo_id", "path", F.coalesce("o", zero).alias("imports"), F.coalesce("i", zero).alias("imported_by")
    )


def _ranked(members: DataFrame) -> DataFrame:
    """members with id: whole numbers in the order of repository and path, without a task that sees them all."""
    ordered = members.select("repo_id", "path", "component").repartitionByRange("repo_id", "path").sortWithinPartitions("repo_id", "path")
    return stage(ordered.withColumn("id", F.monotonically_increasing_id()))


def _inside(edges: DataFrame, ranked: DataFrame) -> DataFrame:
    """s, t: ids of the ends of edges within one component."""
    ends = [ranked.select("repo_id", F.col("path").alias(c), "component", F.col("id").alias(i)) for c, i in (("src", "s"), ("dst", "t"))]
    own = edges.where("src <> dst").select("repo_id", "src", "dst").distinct()
    return own.join(ends[0], ["repo_id", "src"]).join(ends[1], ["repo_id", "dst", "component"]).select("s", "t")


def _turned(cycle: Column) -> Column:
    """A cycle from its least node on."""
    at = F.array_position(cycle, F.array_min(cycle)).cast("int")
    return F.concat(F.slice(cycle, at, F.size(cycle)), F.slice(cycle, F.lit(1), at - 1))


class _Search:
    """Breadth-first searches from many nodes at once, one step a round. A frontier row (x, y, way) is the least way from x to y (to x from y
    if ``back``) of as many steps as rounds; pairs that were met before are left out, in parts that are put together now and then."""

    def __init__(self, steps: DataFrame, start: DataFrame, back: bool):
        self.steps, self.back = steps, back
        self.now = stage(start.distinct().select("x", F.col("x").alias("y"), F.array("x").alias("way")))
        self.met = [self.now.select("x", "y")]

    def keep(self, wanted: DataFrame) -> None:
        """From now on only searches from wanted(x) go on."""
        self.now = self.now.join(wanted, "x", "left_semi")

    def go(self) -> None:
        at, to = ("t", "s") if self.back else ("s", "t")
        longer = self.now.join(self.steps.select(F.col(at).alias("y"), F.col(to).alias("z")), "y")
        way = F.array_prepend("way", F.col("z")) if self.back else F.array_append("way", F.col("z"))
        if len(self.met) > 16:
            self.met = [stage(self._all_met())]
        fresh = longer.select("x", F.col("z").alias("y"), way.alias("way")).groupBy("x", "y").agg(F.min("way").alias("way")).join(self._all_met(), ["x", "y"], "left_anti")
        self.now = stage(fresh)
        self.met.append(self.now.select("x", "y"))

    def _all_met(self) -> DataFrame:
        out = self.met[0]
        for more in self.met[1:]:
            out = out.union(more)
        return out


def detect_cycles(edges: DataFrame, self_loops: bool = False) -> DataFrame:
    """repo_id, cycle, size: for every edge on a cycle the shortest cycle through it, however long (of several the one with the least
    names from the edge on), written from its smallest node, each once. So every component of two files or more has cycles, and they cover
    all its edges. self_loops: files that import themselves are cycles of one.

    Searches start at both ends of all edges within strongly connected components, forward from the file that is
    imported and backward from the one that imports, until they meet: a search looks half a cycle around. Components come whole to the
    tasks that search them; in repositories that don't fit into a task, all searches go one step a round, and the rounds are
    as many as the longest of these cycles has files."""
    edges = stage(edges.select("repo_id", "src", "dst"))
    out = _cycles_and_members(edges)[0].drop("component")
    if self_loops:
        out = out.unionByName(edges.where("src = dst").select("repo_id", F.col("src").alias("cycle"), F.lit(1).alias("size")).distinct())
    return out


def _cycles_and_members(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of staged edges repo_id, cycle, size, component (its least file) of the shortest cycles; repo_id, path, component, size of the files on them."""
    small, large, count = whole.split(edges)
    parts = whole.components(small, count)
    cycles, members = whole.shortest_cycles(parts), whole.members_of(parts)
    if large is not None:
        more = stage(_members_in_rounds(large))
        ranked = _ranked(more)
        members = members.unionByName(more)
        found = _shortest_cycles(_inside(large, ranked))
        cycles = cycles if found is None else cycles.unionByName(_named(found, ranked))
    return cycles, members


def _shortest_cycles(inside: DataFrame) -> DataFrame | None:
    """cycle: of ids, for each edge s, t its shortest cycle, from the least id on, distinct; None without edges."""
    steps = stage(inside)
    open_, parts, length = steps, [], 0
    ahead, back = _Search(steps, open_.select(F.col("t").alias("x")), False), _Search(steps, open_.select(F.col("s").alias("x")), True)
    while not open_.isEmpty():
        length += 1
        side, own = (ahead, "t") if length % 2 else (back, "s")
        side.keep(open_.select(F.col(own).alias("x")).distinct())
        side.go()
        met = open_.join(ahead.now.select(F.col("x").alias("t"), F.col("y").alias("m"), "way"), "t").join(back.now.select(F.col("x").alias("s"), F.col("y").alias("m"), F.col("way").alias("rest")), ["s", "m"])
        # from t to the node before s; s itself begins the cycle
        whole = F.concat(F.array("s"), F.slice(F.concat("way", F.slice("rest", F.lit(2), F.size("rest"))), F.lit(1), F.lit(length)))
        both = stage(open_.join(met.groupBy("s", "t").agg(F.min(whole).alias("cycle")), ["s", "t"], "left"))
        parts.append(both.where("cycle is not null").select(_turned(F.col("cycle")).alias("cycle")))
        open_ = both.where("cycle is null").select("s", "t")
    if not parts:
        return None
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return stage(out.distinct())


def _named(found: DataFrame, ranked: DataFrame) -> DataFrame:
    """repo_id, cycle (names), size, component of cycles of ids."""
    places = found.select("cycle", F.posexplode("cycle").alias("place", "id")).join(ranked.select("id", "repo_id", "path", "component"), "id")
    listed = places.groupBy("repo_id", "component", "cycle").agg(F.array_sort(F.collect_list(F.struct("place", "path"))).alias("l"))
    return listed.select("repo_id", F.array_join("l.path", " > ").alias("cycle"), F.size("l").alias("size"), "component")


def long_cycles(edges: DataFrame, most: int) -> DataFrame:
    """repo_id, cycle, size: cycles of more than ``most`` files: those of detect_cycles, and for every component that has none of
    them but has such a cycle nevertheless (all its edges lie on shorter ones), a shortest such cycle, the least by name.

    For these components, paths of ``most`` edges are extended, one step a round, until one returns to its start; what can't be on
    a cycle of three or more (files with one neighbour, again and again) is left out first. Simple paths can be many: the search is meant
    for small limits, and few components need it."""
    edges = stage(edges.select("repo_id", "src", "dst"))
    if most < 1:
        return detect_cycles(edges)
    cycles, members = _cycles_and_members(edges)
    found = stage(cycles.where(F.col("size") > most))
    listed = found.drop("component")
    done = found.select("repo_id", "component").distinct()
    open_ = stage(members.where(F.col("size") > most).join(done, ["repo_id", "component"], "left_anti").select("repo_id", "path", "component"))
    if open_.isEmpty():
        return listed
    ranked = _ranked(open_)
    left = ranked.select("repo_id", "component", F.col("id").alias("s"))
    steps = stage(_inside(edges, ranked))
    count = steps.count()
    while count:  # files with one neighbour
        both = steps.union(steps.select("t", "s")).toDF("s", "t").distinct()
        inner = both.groupBy("s").agg(F.count("*").alias("n")).where("n > 1").select("s")
        fewer = stage(steps.join(inner, "s", "left_semi").join(inner.withColumnRenamed("s", "t"), "t", "left_semi").select("s", "t"))
        if (now := fewer.count()) == count:
            break
        steps, count = fewer, now
    parts = [ranked.select(F.array("id").alias("cycle")).limit(0)]
    ways = steps.where("t > s").select(F.array("s", "t").alias("way"), F.col("s").alias("first"))
    size = 2
    while count and not ways.isEmpty():
        longer = ways.withColumn("s", F.element_at("way", -1)).join(steps, "s")
        if size > most:
            closed = longer.where("t = first").groupBy("first").agg(F.min("way").alias("cycle")).join(left.withColumnRenamed("s", "first"), "first")
            closed = stage(closed.groupBy("repo_id", "component").agg(F.min("cycle").alias("cycle")))
            parts.append(closed.select("cycle"))
            gone = left.join(closed, ["repo_id", "component"]).select(F.col("s").alias("first"))
            longer = longer.join(gone, "first", "left_anti")
        ways = stage(longer.where((F.col("t") > F.col("first")) & ~F.array_contains("way", F.col("t"))).select(F.array_append("way", F.col("t")).alias("way"), "first"))
        size += 1
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return listed.unionByName(_named(out, ranked).drop("component"))


def short_cycles(edges: DataFrame, max_len: int = 4) -> DataFrame:
    """All simple cycles of at most max_len nodes (there can be exponentially many longer ones), each once, its smallest node first; bound:
    max_len. Paths are only walked within strongly connected components, which come whole to the tasks that walk them, but for repositories
    that don't fit into a task."""
    edges = stage(edges.select("repo_id", "src", "dst"))
    small, large, count = whole.split(edges)
    out = whole.short_cycles(whole.components(small, count), max_len)
    if large is not None:
        out = out.unionByName(_short_in_rounds(large, max_len))
    return out.withColumn("bound", F.lit(max_len))


def _short_in_rounds(edges: DataFrame, max_len: int) -> DataFrame:
    ranked = _ranked(_members_in_rounds(edges))
    steps = stage(_inside(edges, ranked))
    ways, found = steps.where("t > s").select(F.array("s", "t").alias("cycle")), None
    for size in range(2, max_len + 1):
        longer = ways.withColumn("s", F.element_at("cycle", -1)).join(steps, "s")
        closed = longer.where(F.col("t") == F.get("cycle", 0)).select("cycle")
        found = closed if found is None else found.unionByName(closed)
        if size < max_len:
            ways = stage(longer.where((F.col("t") > F.get("cycle", 0)) & ~F.array_contains("cycle", F.col("t"))).select(F.array_append("cycle", F.col("t")).alias("cycle")))
    return _named(found, ranked).drop("component")


def cycle_edges(edges: DataFrame) -> DataFrame:
    """Edges on any cycle, however long: those within one strongly connected component."""
    edges = stage(edges.select("repo_id", "src", "dst"))
    members = cycle_members(edges)
    ends = [members.select("repo_id", F.col("path").alias(c), "component") for c in ("src", "dst")]
    inside = edges.where("src <> dst").join(ends[0], ["repo_id", "src"]).join(ends[1], ["repo_id", "dst", "component"])
    return inside.select("repo_id", "src", "dst").distinct()


def _peel_once(edges: DataFrame) -> DataFrame:
    heads = edges.select("repo_id", F.col("src").alias("node")).distinct()
    tails = edges.select("repo_id", F.col("dst").alias("node")).distinct()
    inner = heads.join(tails, ["repo_id", "node"])
    after = edges.join(inner.withColumnRenamed("node", "src"), ["repo_id", "src"], "left_semi").join(inner.withColumnRenamed("node", "dst"), ["repo_id", "dst"], "left_semi")
    return after.select("repo_id", "src", "dst")


#: Edges fall off, and chains are contracted, as long as a round takes away this share of the edges.
WORTH = 1 / 16


def peel(edges: DataFrame) -> tuple[DataFrame, int]:
    """A staged table of the edges without those of nodes that have no edge in or none out, again and again as long as many fall off; and
    how many are left."""
    spark = edges.sparkSession
    now, path = stage_at(edges)
    count = now.count()
    while count:
        after, after_path = stage_at(_peel_once(now))
        left = after.count()
        unstage(spark, path)
        now, path, enough = after, after_path, left > (1 - WORTH) * count
        count = left
        if enough:
            break
    return now, count


def follow(steps: DataFrame) -> DataFrame:
    """Where steps(repo_id, node, next, length, floor) lead in the end, by pointer jumping: repo_id, node, last (the last node with a step),
    next (a node without one), length (of all steps), floor (the greatest of the steps' floors, each with the lengths before it), ring (whether
    the node leads into a ring instead) and least (for nodes on a ring its least node).

    Every round doubles the stretch that a pointer spans. On a path each round ends more pointers, so when no pointer ended
    and no stretch found a lesser node, the open ones lead into rings."""
    spark = steps.sparkSession
    start = steps.select("repo_id", "node", F.col("node").alias("last"), "next", F.col("node").alias("least"), F.col("length").cast("long").alias("length"), F.col("floor").cast("long").alias("floor"))
    beyond = steps.select("repo_id", F.col("node").alias("next"), F.lit(True).alias("open"))
    now, path = stage_at(start.join(beyond, ["repo_id", "next"], "left").withColumns({"open": F.coalesce("open", F.lit(False)), "changed": F.lit(True)}))
    before = None
    while True:
        mark = now.where("open").agg(F.count("*"), F.count_if("changed")).first()
        if mark[0] == 0 or (before == mark[0] and mark[1] == 0):
            break
        before = mark[0]
        on = now.select("repo_id", F.col("node").alias("next"), *(F.col(c).alias(f"{c}_") for c in ("last", "next", "least", "length", "floor", "open")))
        joined = now.join(on, ["repo_id", "next"], "left")
        more = F.col("next_").isNotNull()
        after, after_path = stage_at(
            joined.select(
                "repo_id", "node", *(F.when(more, F.col(f"{c}_")).otherwise(F.col(c)).alias(c) for c in ("last", "next", "open")), F.least("least", "least_").alias("least"),
                (F.col("length") + F.coalesce("length_", F.lit(0))).alias("length"), F.greatest("floor", F.col("length") + F.col("floor_")).alias("floor"),
                F.coalesce(F.col("least_") < F.col("least"), F.lit(False)).alias("changed"),
            )
        )
        unstage(spark, path)
        now, path = after, after_path
    return now.select("repo_id", "node", "last", "next", "length", "floor", F.col("open").alias("ring"), "least")


def _contract(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Chains of nodes with one edge in and one out, as one edge each: the edges left, chains(repo_id, node, head, tail) and rings(repo_id,
    path, component); None without such nodes."""
    ends = edges.select("repo_id", F.col("src").alias("node"), F.col("dst").alias("next"), F.lit(None).cast("string").alias("before")).unionByName(
        edges.select("repo_id", F.col("dst").alias("node"), F.lit(None).cast("string").alias("next"), F.col("src").alias("before"))
    )
    counts = ends.groupBy("repo_id", "node").agg(F.count("next").alias("o"), F.count("before").alias("i"), F.min("next").alias("next"), F.min("before").alias("before"))
    single = stage(counts.where("o = 1 and i = 1").select("repo_id", "node", "next", "before"))
    if single.isEmpty():
        return None
    led = follow(single.select("repo_id", "node", "next", F.lit(1).alias("length"), F.lit(0).alias("floor")))
    rings = led.where("ring").select("repo_id", F.col("node").alias("path"), F.col("least").alias("component"))
    inside = led.where("not ring").select("repo_id", "node", "last", F.col("next").alias("tail"))
    first = single.join(single.select("repo_id", F.col("node").alias("before")), ["repo_id", "before"], "left_anti").select("repo_id", "node", F.col("before").alias("head"))
    heads = inside.join(first, ["repo_id", "node"]).select("repo_id", "last", "head")
    chains = stage(inside.join(heads, ["repo_id", "last"]).select("repo_id", "node", "head", "tail"))
    gone = single.select("repo_id", "node")
    kept = edges.join(gone.withColumnRenamed("node", "src"), ["repo_id", "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), ["repo_id", "dst"], "left_anti")
    short = chains.where("head <> tail").select("repo_id", F.col("head").alias("src"), F.col("tail").alias("dst"))
    return kept.select("repo_id", "src", "dst").unionByName(short).distinct(), chains, rings


def _labels(edges: DataFrame) -> DataFrame:
    """repo_id, node, f, b: the least node that reaches a node, and the least that it reaches."""
    spark = edges.sparkSession
    nodes = edges.select("repo_id", F.col("src").alias("node")).union(edges.select("repo_id", F.col("dst").alias("node"))).distinct()
    label, path = stage_at(nodes.select("repo_id", "node", F.col("node").alias("f"), F.col("node").alias("b"), F.lit(False).alias("changed")))
    while True:
        none = F.lit(None).cast("string")
        ahead = edges.join(label.withColumnRenamed("node", "src"), ["repo_id", "src"]).select("repo_id", F.col("dst").alias("node"), "f", none.alias("b"), none.alias("f0"), none.alias("b0"))
        back = edges.join(label.withColumnRenamed("node", "dst"), ["repo_id", "dst"]).select("repo_id", F.col("src").alias("node"), none.alias("f"), "b", none.alias("f0"), none.alias("b0"))
        own = label.select("repo_id", "node", "f", "b", F.col("f").alias("f0"), F.col("b").alias("b0"))
        least = own.unionByName(ahead).unionByName(back).groupBy("repo_id", "node").agg(F.min("f").alias("f"), F.min("b").alias("b"), F.min("f0").alias("f0"), F.min("b0").alias("b0"))
        after, after_path = stage_at(least.select("repo_id", "node", "f", "b", ((F.col("f") < F.col("f0")) | (F.col("b") < F.col("b0"))).alias("changed")))
        stable = after.where("changed").isEmpty()
        unstage(spark, path)
        label, path = after, after_path
        if stable:
            return label.drop("changed")


def cycle_members(edges: DataFrame) -> DataFrame:
    """Nodes on any cycle, with the least node and the size of their strongly connected component."""
    edges = stage(edges.where("src <> dst").select("repo_id", "src", "dst"))
    small, large, count = whole.split(edges)
    out = whole.members(small, count)
    return out if large is None else out.unionByName(_members_in_rounds(large))


def _members_in_rounds(edges: DataFrame) -> DataFrame:
    """Members of the components of large repositories.

    Nodes without edges in or out fall off, and chains of nodes with one edge in and one out become one edge each (by pointer jumping, so
    in rounds logarithmic in their length; rings of such nodes are components), as long as that is worth it. Then every
    node learns the least node that reaches it and the least that it reaches. Where both are one node, that is the component; edges
    between nodes that differ in either can't be in a component and go. So every part of the graph finds a component, and the rest goes
    the same way again. In the end the chains are undone, the last first: a chain whose ends are in one component is in it."""
    now = edges.where("src <> dst").select("repo_id", "src", "dst").distinct()
    levels: list[DataFrame] = []
    found: DataFrame | None = None
    while True:
        now, count = peel(now)
        before = 2 * count
        while count and count < (1 - WORTH) * before and (parts := _contract(now)):
            short, chains, rings = parts
            levels.append(chains)
            found = rings if found is None else found.unionByName(rings)
            before = count
            now, count = peel(short)
        if not count:
            break
        label = _labels(now)
        core = label.where("f = b").select("repo_id", F.col("node").alias("path"), F.col("f").alias("component"))
        found = core if found is None else found.unionByName(core)
        open_ = label.where("f <> b")
        ends = [open_.select("repo_id", F.col("node").alias(c), "f", "b") for c in ("src", "dst")]
        now = now.join(ends[0], ["repo_id", "src"]).join(ends[1], ["repo_id", "dst", "f", "b"]).select("repo_id", "src", "dst")
    if found is None:
        return edges.select("repo_id", F.col("src").alias("path"), F.col("src").alias("component"), F.lit(0).cast("long").alias("size")).limit(0)
    for chains in reversed(levels):
        loops = chains.where("head = tail").select("repo_id", F.col("head").alias("path")).distinct()
        found = found.unionByName(loops.join(found, ["repo_id", "path"], "left_anti").select("repo_id", "path", F.col("path").alias("component")))
        of = [found.select("repo_id", F.col("path").alias(c), "component") for c in ("head", "tail")]
        within = chains.join(of[0], ["repo_id", "head"]).join(of[1], ["repo_id", "tail", "component"])
        found = stage(found.unionByName(within.select("repo_id", F.col("node").alias("path"), "component")))
    named = found.groupBy("repo_id", "component").agg(F.min("path").alias("least"), F.count("*").alias("size")).where("size > 1")
    return found.join(named, ["repo_id", "component"]).select("repo_id", "path", F.col("least").alias("component"), "size")


def topological_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """depth of each node: 0 without imports, else one more than its deepest import; null on and above cycles."""
    own = stage(edges.where("src <> dst").select("repo_id", "src", "dst"))
    small, large, count = whole.split(own)
    named = F.col("repo_id").isNotNull() & F.col("path").isNotNull()
    nodes = nodes.select("repo_id", "path")
    here = nodes if large is None else nodes.join(large.select("repo_id").distinct(), "repo_id", "left_anti")
    out = whole.depths(here, small, count).unionByName(nodes.where(~named).withColumn("depth", F.lit(None).cast("int")))
    if large is not None:
        out = out.unionByName(_layers_in_rounds(nodes.where(named).join(large.select("repo_id").distinct(), "repo_id", "left_semi"), large))
    return out


def _layers_in_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Depths in large repositories.

    Each round takes the nodes settled in the last one, counts them off the imports that their importers wait for, and settles
    those that wait for none. After rounds 1, 16, 32, 64, ... nodes that wait for one import alone are contracted: such a
    chain is followed by pointer jumping (depths along it are the greater of a floor and a length added), so a long chain takes a
    logarithmic number of rounds."""
    spark = nodes.sparkSession
    own = stage(edges.where("src <> dst").select("repo_id", "src", "dst", F.lit(1).cast("long").alias("length")).distinct())
    waits = own.groupBy("repo_id", F.col("src").alias("path")).agg(F.count("*").alias("open"))
    start = nodes.select("repo_id", "path").distinct().join(waits, ["repo_id", "path"], "left").withColumn("open", F.coalesce("open", F.lit(0)))
    zero = F.lit(0).cast("long")
    state, path = stage_at(start.select("repo_id", "path", "open", zero.alias("floor"), F.when(F.col("open") == 0, zero).alias("depth"), F.when(F.col("open") == 0, F.lit(0)).alias("turn")))
    jumps: list[DataFrame] = []
    turn, due = 0, 1
    while not state.where(F.col("turn") == turn).isEmpty():
        settled = state.where(F.col("turn") == turn).select("repo_id", F.col("path").alias("dst"), "depth")
        less = own.join(settled, ["repo_id", "dst"]).groupBy("repo_id", F.col("src").alias("path")).agg(F.count("*").alias("less"), F.max(F.col("depth") + F.col("length")).alias("reach"))
        turn += 1
        left = F.col("open") - F.coalesce("less", F.lit(0))
        fresh = F.col("depth").isNull() & (left == 0)
        floor = F.greatest("floor", "reach")
        after, after_path = stage_at(
            state.join(less, ["repo_id", "path"], "left").select(
                "repo_id", "path", left.alias("open"), floor.alias("floor"), F.when(fresh, floor).otherwise(F.col("depth")).alias("depth"), F.when(fresh, F.lit(turn)).otherwise(F.col("turn")).alias("turn")
            )
        )
        unstage(spark, path)
        state, path = after, after_path
        if turn == due:
            due = max(16, 2 * due)
            own, state, jump = _contract_waiting(own, state, turn)
            jumps += [] if jump is None else [jump]
    depths = state.where("depth is not null").select("repo_id", "path", "depth")
    for jump in reversed(jumps):
        on = jump.join(depths.withColumnRenamed("path", "next"), ["repo_id", "next"])
        depths = stage(depths.unionByName(on.select("repo_id", F.col("node").alias("path"), F.greatest("floor", F.col("length") + F.col("depth")).alias("depth"))))
    return nodes.select("repo_id", "path").join(depths.select("repo_id", "path", F.col("depth").cast("int").alias("depth")), ["repo_id", "path"], "left")


def _contract_waiting(own: DataFrame, state: DataFrame, turn: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """own and state without the nodes that wait for one import alone, whose importers now wait for where these lead; and where they lead
    (repo_id, node, next, length, floor). Nodes settled in this turn still count as waited for."""
    waiting = state.where("depth is null")
    past = state.where(F.col("turn") < turn).select("repo_id", F.col("path").alias("dst"))
    live = stage(own.join(waiting.select("repo_id", F.col("path").alias("src")), ["repo_id", "src"], "left_semi").join(past, ["repo_id", "dst"], "left_anti"))
    single = stage(waiting.where("open = 1").select("repo_id", F.col("path").alias("src"), "floor").join(live, ["repo_id", "src"]).select("repo_id", F.col("src").alias("node"), F.col("dst").alias("next"), "length", "floor"))
    if single.isEmpty():
        return own, state, None
    jump = stage(follow(single).where("not ring").select("repo_id", "node", "next", "length", "floor"))
    rest = live.join(single.select("repo_id", F.col("node").alias("src")), ["repo_id", "src"], "left_anti")
    led = rest.join(jump.select("repo_id", F.col("node").alias("dst"), "next", F.col("length").alias("more"), "floor"), ["repo_id", "dst"], "left")
    far = stage(
        led.select("repo_id", "src", F.coalesce("next", "dst").alias("dst"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"), (F.col("length") + F.col("floor")).alias("reach"))
        .groupBy("repo_id", "src", "dst").agg(F.max("length").alias("length"), F.max("reach").alias("reach"))
    )
    counts = far.groupBy("repo_id", F.col("src").alias("path")).agg(F.count("*").alias("now"), F.max("reach").alias("reach"))
    kept = state.join(single.select("repo_id", F.col("node").alias("path")), ["repo_id", "path"], "left_anti").join(counts, ["repo_id", "path"], "left")
    kept = kept.select("repo_id", "path", F.when(F.col("depth").isNull(), F.col("now")).otherwise(F.col("open")).alias("open"), F.greatest("floor", "reach").alias("floor"), "depth", "turn")
    return far.select("repo_id", "src", "dst", "length"), stage(kept), jump


def layer_name(depth: Column) -> Column:
    names = F.array(*map(F.lit, LAYERS))
    return F.when(depth < len(LAYERS), F.get(names, depth)).otherwise(F.concat(F.lit("layer_"), depth.cast("string")))


def heuristic_layer(path: Column, purpose: Column | None = None) -> Column:
    """The first group of words of which one occurs in the path, else in what the file is for."""

    def by(text: Column, words: tuple, other: Column) -> Column:
        layer = other
        for name, of in reversed(words):
            layer = F.when(F.lower(text).rlike("|".join(of)), name).otherwise(layer)
        return layer

    other = F.lit("foundation")
    if purpose is not None:
        other = by(F.coalesce(purpose, F.lit("")), PURPOSE_WORDS, other)
    return by(path, LAYER_WORDS, other)


def assign_layers(nodes: DataFrame, edges: DataFrame, purposes: DataFrame | None = None) -> DataFrame:
    """By depth where there is one; a node without any edge, and nodes on or above cycles, by words of the path and, where
    purposes(repo_id, path, purpose) are given, of the purpose. What no word tells keeps its depth's layer."""
    depths = topological_layers(nodes, edges).join(degrees(nodes, edges), ["repo_id", "path"])
    isolated = (F.col("imports") == 0) & (F.col("imported_by") == 0)
    words = heuristic_layer(F.col("path"))
    if purposes is not None:
        depths = depths.join(purposes.select("repo_id", "path", "purpose"), ["repo_id", "path"], "left")
        words = heuristic_layer(F.col("path"), F.col("purpose"))
    layer = F.when(F.col("depth").isNull() | isolated, words).otherwise(layer_name(F.col("depth")))
    return depths.select("repo_id", "path", layer.alias("layer"))


def layer_histogram(layers: DataFrame) -> DataFrame:
    return layers.groupBy("repo_id", F.coalesce(F.nullif("layer", F.lit("")), F.lit("unknown")).alias("layer")).agg(F.count("*").alias("n_files"))


def graph_stats(nodes: DataFrame, edges: DataFrame, counted: dict[str, DataFrame] | None = None, columns: dict[str, DataFrame] | None = None) -> DataFrame:
    """Per repository: files, imports, files that import, files that are imported; n_<name> for each table of ``counted`` (cycles,
    refs, calls, unused imports, endpoints, models, issues: its rows, 0 without any), and the columns of each table of
    ``columns`` with one row a repository (lines, grade)."""
    out = nodes.groupBy("repo_id").agg(F.count("*").alias("n_files"))
    e = edges.groupBy("repo_id").agg(F.count("*").alias("n_imports"), F.count_distinct("src").alias("n_importing"), F.count_distinct("dst").alias("n_imported"))
    out = out.join(e, "repo_id", "left")
    names = ["n_imports", "n_importing", "n_imported"]
    for name, table in (counted or {}).items():
        out = out.join(table.groupBy("repo_id").agg(F.count("*").alias(f"n_{name}")), "repo_id", "left")
        names.append(f"n_{name}")
    out = out.select("repo_id", "n_files", *(F.coalesce(c, F.lit(0)).alias(c) for c in names))
    for table in (columns or {}).values():
        out = out.join(table, "repo_id", "left")
    return out


def call_rollup(calls: DataFrame, show: int = 5) -> DataFrame:
    """Per called file: sites, distinct callers and the first few of them by name. The callers are ranked before any are listed, so a file
    that all others call lists a few names only."""
    callers = calls.groupBy("repo_id", "dst", "src").agg(F.count("*").alias("n"))
    counts = callers.groupBy("repo_id", "dst").agg(F.sum("n").alias("n_calls"), F.count("*").alias("n_callers"))
    few = callers.withColumn("turn", F.row_number().over(Window.partitionBy("repo_id", "dst").orderBy("src"))).where(F.col("turn") <= show)
    names = few.groupBy("repo_id", "dst").agg(F.array_join(F.array_sort(F.collect_list("src")), ",").alias("first_callers"))
    return counts.join(names, ["repo_id", "dst"])


def search_links(nodes: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """Edges of which an end's path contains ``text``."""
    hit = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
    return edges.where(hit("src") | hit("dst"))
