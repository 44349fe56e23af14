"""Components, reachability, bridges and isolation of the physical graph."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialise
from .layout import mapped, ship

#: Edges up to which one task labels a graph by union and find; beyond, rounds over tables do, with
#: the same labels.
ONE_TASK = 2_000_000
#: Arcs or links up to which a graph is broadcast to workers.
MAX_LINKS = 20_000_000


def undirected(links: DataFrame) -> DataFrame:
    """(u, v, link_id) of links that join two nodes."""
    return links.where("source <> target").select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"), "link_id")


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict = {}

    def find(x):  # noqa: ANN001, ANN202
        while (up := root[x]) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = find(root.setdefault(u, u)), find(root.setdefault(v, v))
            if a != c:
                root[max(a, c)] = min(a, c)
    if root:
        yield pa.RecordBatch.from_arrays([pa.array(list(root)), pa.array([find(x) for x in root])], names=["node", "component"])


def _state(edges: DataFrame) -> tuple:
    # xor of the hashes: no overflow, independent of the order of rows
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def _stars(e: DataFrame, rounds: int, tag: str) -> DataFrame:
    """Alternating large-star and small-star rounds: each is a hash aggregation with a map-side
    minimum and an equi-join; no neighbour list is ever gathered."""
    last = _state(e)
    for _ in range(rounds):
        if not last[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(large_min, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(large_min.select("u", F.col("m").alias("v"))).distinct(), tag)
        now = _state(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    # at the fixed point every edge leads to the smallest node of its component
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def label_edges(edges: DataFrame, one_task: int = ONE_TASK, rounds: int = 60, tag: str = "labels") -> DataFrame:
    """``edges(u, v)`` -> (node, component), component being the smallest node reachable. Only nodes
    with an edge to another node are returned."""
    e = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), tag)
    if one_task and e.count() <= one_task:
        kind = e.schema["u"].dataType.simpleString()
        return materialise(e.coalesce(1).mapInArrow(_union_find, f"node {kind}, component {kind}"), tag)
    return _stars(e, rounds, tag)


def components(nodes: DataFrame, links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node_id, component): the smallest node reachable either way along links."""
    label = label_edges(undirected(links).select("u", "v"), one_task)
    return nodes.join(label, F.col("node_id") == F.col("node"), "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def group_pieces(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(g, node, piece): the connected pieces of each closure group, by the smallest node of each."""
    key = lambda c: F.concat_ws("\x01", "closure_group_id", F.lpad(F.col(c).cast("string"), 20, "0"))
    # a group's name and a node's number as one key: keys of one group sort by their nodes
    ends = links.select(F.col("closure_group_id").alias("g"), F.explode(F.array(F.struct(F.col("source").alias("node"), key("source").alias("k")), F.struct(F.col("target").alias("node"), key("target").alias("k")))).alias("n"))
    ends = ends.select("g", "n.node", "n.k").distinct()
    label = label_edges(links.where("source <> target").select(key("source").alias("u"), key("target").alias("v")), one_task)
    named = ends.join(label.select(F.col("node").alias("k"), "component"), "k", "left")
    return named.select("g", "node", F.coalesce(F.substring_index("component", "\x01", -1).cast("long"), "node").alias("piece"))


def reach(arcs: DataFrame, starts: DataFrame, limit: int, rounds: int = 10_000) -> DataFrame:
    """(start, node) reachable along arcs; each start stops growing beyond ``limit`` nodes."""
    step = arcs.select(F.col("source").alias("node"), F.col("target").alias("to")).distinct()
    seen = materialise(starts.select("start", F.col("start").alias("node")).distinct(), "reach")
    frontier = seen
    for _ in range(rounds):
        open_ = seen.groupBy("start").agg(F.count("*").alias("n")).where(F.col("n") <= limit).select("start")
        new = frontier.join(open_, "start", "left_semi").join(step, "node").select("start", F.col("to").alias("node")).distinct()
        frontier = materialise(new.join(seen, ["start", "node"], "left_anti"), "reach-front")
        if frontier.isEmpty():
            return seen
        seen = materialise(seen.unionByName(frontier), "reach")
    return seen


def degrees(links: DataFrame) -> DataFrame:
    """(node_id, degree): distinct links that end at a node."""
    ends = links.select(F.col("source").alias("node_id"), "link_id").union(links.select("target", "link_id"))
    return ends.groupBy("node_id").agg(F.countDistinct("link_id").alias("degree"))


_LOW = "kind string, id long, bridge boolean, smaller_side long, block long, articulation boolean, tin long, tout long, component_nodes long"


def _depth_first(pdf: pd.DataFrame) -> pd.DataFrame:
    """One component by depth first: bridges with the nodes of their smaller side, blocks (parts
    without a cut node, by their smallest link), cut nodes, and the places of nodes in the walk.
    Parallel links are told apart by their ids."""
    around: dict[int, list[tuple[int, int]]] = {}
    for u, v, i in zip(pdf["u"].tolist(), pdf["v"].tolist(), pdf["link_id"].tolist(), strict=True):
        around.setdefault(u, []).append((v, i))
        around.setdefault(v, []).append((u, i))
    for x in around.values():
        x.sort()
    root = min(around)
    tin, low, size, clock = {root: 0}, {root: 0}, {root: 1}, 1
    bridge: dict[int, int] = {}
    block: dict[int, int] = {}
    cut, open_links, children = set(), [], 0
    stack = [(root, None, None, iter(around[root]))]
    while stack:
        node, parent, via, rest = stack[-1]
        for to, link in rest:
            if link == via:
                continue
            if to in tin:
                if tin[to] < tin[node]:
                    open_links.append(link)
                    low[node] = min(low[node], tin[to])
            else:
                tin[to] = low[to] = clock
                size[to] = 1
                clock += 1
                open_links.append(link)
                stack.append((to, node, link, iter(around[to])))
                break
        else:
            stack.pop()
            if not stack:
                continue
            low[parent] = min(low[parent], low[node])
            size[parent] += size[node]
            if low[node] > tin[parent]:
                bridge[via] = size[node]
            if low[node] >= tin[parent]:
                if parent == root:
                    children += 1
                else:
                    cut.add(parent)
                part = []
                while True:
                    part.append(open_links.pop())
                    if part[-1] == via:
                        break
                block.update(dict.fromkeys(part, min(part)))
    if children > 1:
        cut.add(root)
    n = len(tin)
    rows = [("link", i, i in bridge, min(bridge[i], n - bridge[i]) if i in bridge else None, b, None, None, None, n) for i, b in block.items()]
    rows += [("node", x, None, None, None, x in cut, t, t + size[x] - 1, n) for x, t in tin.items()]
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _LOW.split(", ")])
    return out.astype({c: "Int64" for c in ("smaller_side", "block", "tin", "tout")} | {c: "boolean" for c in ("bridge", "articulation")})


def depth_first(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Rows for links (bridge, smaller_side, block) and nodes (articulation, tin, tout). One task for
    each component: the search is sequential, and linear in the component's links."""
    e = undirected(links).join(labels.withColumnRenamed("node_id", "u"), "u")
    return e.groupBy("component").applyInPandas(_depth_first, _LOW)


def bridges(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(link_id, smaller_side, component_nodes) of links whose removal parts their component."""
    return depth_first(labels, links).where("bridge").select(F.col("id").alias("link_id"), "smaller_side", "component_nodes")


def component_rollup(labels: DataFrame, links: DataFrame) -> DataFrame:
    """component, nodes, links, length_mm, urgent links (``rca_code`` 1)."""
    nodes = labels.groupBy("component").agg(F.count("*").alias("nodes"))
    inside = links.join(labels, links.source == labels.node_id).groupBy("component").agg(F.count("*").alias("links"), F.sum("length_mm").alias("length_mm"), F.sum(F.when(F.col("rca_code") == 1, 1).otherwise(0)).alias("highway_links"))
    return nodes.join(inside, "component", "left").select("component", "nodes", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("length_mm", F.lit(0)).alias("length_mm"), F.coalesce("highway_links", F.lit(0)).alias("highway_links"))


def principal(rollup: DataFrame) -> DataFrame:
    """The component with most highway links, then most nodes, then the smallest id."""
    return rollup.orderBy(F.desc("highway_links"), F.desc("nodes"), "component").limit(1)


def closure_shapes(links: DataFrame) -> DataFrame:
    """The shape of each closure group by its own degrees and pieces: single_segment, simple_chain,
    cycle, branching, or disjoint where it has more than one piece."""
    g = F.col("closure_group_id")
    ends = links.select(g, F.col("source").alias("node")).unionAll(links.select(g, "target"))
    inner = ends.groupBy(g, "node").agg(F.count("*").alias("d"))
    by = inner.groupBy(g).agg(F.count("*").alias("nodes"), F.max("d").alias("most"), F.count_if(F.col("d") == 1).alias("tips"))
    pieces = group_pieces(links).groupBy(F.col("g").alias("closure_group_id")).agg(F.countDistinct("piece").alias("pieces"))
    n = links.groupBy(g).agg(F.count("*").alias("links"), F.sum("length_mm").alias("length_mm"))
    shape = (
        F.when(F.col("links") == 1, "single_segment")
        .when(F.col("pieces") > 1, "disjoint")
        .when(F.col("most") > 2, "branching")
        .when(F.col("tips") == 0, "cycle")
        .otherwise("simple_chain")
    )
    return n.join(by, "closure_group_id").join(pieces, "closure_group_id").select("closure_group_id", "links", "nodes", "pieces", "length_mm", shape.alias("shape"))


# --- isolation ---------------------------------------------------------------------------------
class Roads:
    """The undirected graph as flat arrays: for each node its neighbours and the links to them."""

    @staticmethod
    def lay_out(u: np.ndarray, v: np.ndarray, group: np.ndarray) -> dict[str, np.ndarray]:
        names = np.unique(np.concatenate([u, v])).astype(np.int64)
        small = lambda x: x.astype(np.int32) if len(x) < 2**31 else x
        s, t = np.searchsorted(names, u), np.searchsorted(names, v)
        ends = np.concatenate([s, t])
        order = np.argsort(ends, kind="stable")
        groups, own = np.unique(group, return_inverse=True)
        return {"names": names, "groups": groups, "at": np.concatenate(([0], np.cumsum(np.bincount(ends, minlength=len(names))))), "to": small(np.concatenate([t, s])[order]), "group": small(np.concatenate([own, own])[order])}

    def __init__(self, names: np.ndarray, groups: np.ndarray, at: np.ndarray, to: np.ndarray, group: np.ndarray) -> None:
        self.names, self.groups, self.at, self.to, self.group = (memoryview(x) for x in (names, groups, at, to, group))

    def place(self, node: int) -> int:
        return bisect_left(self.names, node)

    def parts(self, banned: int, starts: list[int]) -> tuple[list[tuple[int, list[int]]], int | None]:
        """What removing a group leaves around its nodes: the parts that end, each with its smallest
        start and all its nodes, and the smallest start of the part that goes on (None if none does). Searches grow from all
        starts in turn, and those that meet go on as one, so the last one left is never walked
        further than the others together."""
        banned = bisect_left(self.groups, banned)
        owner = {self.place(s): i for i, s in enumerate(starts)}
        root = list(range(len(starts)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        queue = [deque([self.place(s)]) for s in starts]
        inside = [[self.place(s)] for s in starts]
        while True:
            live = sorted({find(i) for i in range(len(starts)) if queue[find(i)]})
            if len(live) <= 1:
                break
            for r in live:
                if find(r) != r or not queue[r]:
                    continue
                n = queue[r].popleft()
                for k in range(self.at[n], self.at[n + 1]):
                    if self.group[k] == banned:
                        continue
                    m = self.to[k]
                    if m not in owner:
                        owner[m] = r
                        queue[r].append(m)
                        inside[r].append(m)
                    elif (o := find(owner[m])) != r:
                        a, b = (r, o) if len(inside[r]) >= len(inside[o]) else (o, r)
                        root[b] = a
                        queue[a].extend(queue[b])
                        inside[a] += inside[b]
                        queue[b], inside[b] = deque(), []
                        r = a
        going = live[0] if live else None
        first = {}
        for i, s in enumerate(starts):
            first[find(i)] = min(s, first.get(find(i), s))
        return [(s, [self.names[n] for n in inside[i]]) for i, s in first.items() if i != going], None if going is None else first[going]


_ROADS: dict[str, Roads] = {}


def _roads(key: str, shared) -> Roads:  # noqa: ANN001
    """One graph for each worker process, in pages common to all of an executor."""
    if key not in _ROADS:
        _ROADS.clear()
        _ROADS[key] = Roads(**mapped(shared)[0])
    return _ROADS[key]


def isolation_parts(links: DataFrame, closures: DataFrame | None = None) -> DataFrame:
    """(g, part, node) of the parts that each closure group cuts off the part that goes on, by the
    smallest closure node in each, and one row with part null for the part that goes on. Where every
    part ends (a small component), all of them are listed."""
    spark = links.sparkSession
    n = links.count()
    if n > MAX_LINKS:
        raise ValueError(f"{n} links are more than the {MAX_LINKS} that a worker lays out; part the network by component")
    g = F.col("closure_group_id")
    e = undirected(links).join(links.select("link_id", F.xxhash64(g).alias("h")), "link_id").select("u", "v", "h").toArrow()
    shared, key = ship(spark.sparkContext, Roads.lay_out(*(e.column(i).to_numpy() for i in range(3))))
    ask = links.where("source <> target")
    if closures is not None:
        ask = ask.join(closures, "closure_group_id", "left_semi")
    ask = ask.select(g.alias("g"), F.explode(F.array("source", "target")).alias("n")).groupBy("g").agg(F.sort_array(F.collect_set("n")).alias("starts")).withColumn("h", F.xxhash64("g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roads = _roads(key, shared)
        for b in batches:
            for group, starts, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ended, going = roads.parts(h, starts)
                part = [s for s, p in ended for _ in p]
                node = [x for _, p in ended for x in p]
                if going is not None:
                    part.append(None)
                    node.append(going)
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(part)), pa.array(part, pa.int64()), pa.array(node, pa.int64())], names=["g", "part", "node"])

    return ask.repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(run, "g string, part long, node long")


def isolation(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Exact parts that each closure leaves of its component: how many, which of them keeps the
    principal connection (most highway links, most nodes, smallest closure node), what the others hold, and
    whether that choice is supported: it is ambiguous where the two best parts have as many highway
    links and neither has twice the nodes of the other."""
    parts = materialise(isolation_parts(links), "isolation-parts")
    ends = links.where("source <> target").select("link_id", F.col("closure_group_id").alias("own"), "source", "length_mm", (F.col("rca_code") == 1).cast("int").alias("highway"))
    known = parts.where("part is not null")
    nodes = known.groupBy("g", "part").agg(F.count("*").alias("nodes"))
    inside = known.join(ends, known.node == ends.source).where("own <> g").groupBy("g", "part").agg(F.count("*").alias("links"), F.sum("length_mm").alias("length_mm"), F.sum("highway").alias("highway_links"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    ended = nodes.join(inside, ["g", "part"], "left").select("g", "part", "nodes", zero("links"), zero("length_mm"), zero("highway_links"))
    # the part that goes on: its component without the closure and without the parts that ended
    of = labels.select(F.col("node_id").alias("n0"), "component")
    total = component_rollup(labels, links.where("source <> target"))
    closed = links.where("source <> target").groupBy(F.col("closure_group_id").alias("g"), F.col("source").alias("n0")).agg(F.count("*").alias("links"), F.sum("length_mm").alias("length_mm"), F.count_if(F.col("rca_code") == 1).alias("highway_links")).join(of, "n0")
    less = ended.join(of, ended.part == of.n0).select("g", "component", "nodes", "links", "length_mm", "highway_links").unionByName(closed.select("g", "component", F.lit(0).cast("long").alias("nodes"), "links", "length_mm", "highway_links"))
    less = less.groupBy("g", "component").agg(*(F.sum(c).alias(f"less_{c}") for c in ("nodes", "links", "length_mm", "highway_links")))
    going = parts.where("part is null").join(of, F.col("node") == F.col("n0")).select("g", F.col("node").alias("going"), "component").join(total, "component").join(less, ["g", "component"])
    going = going.select("g", F.col("going").alias("part"), *((F.col(c) - F.col(f"less_{c}")).alias(c) for c in ("nodes", "links", "length_mm", "highway_links")))
    every = ended.unionByName(going)
    w = Window.partitionBy("g").orderBy(F.desc("highway_links"), F.desc("nodes"), "part")
    ranked = every.withColumn("r", F.row_number().over(w))
    rest = F.col("r") > 1
    by = ranked.groupBy("g").agg(
        F.count("*").alias("parts"),
        *(F.sum(F.when(rest, F.col(c)).otherwise(0)).alias(f"separated_{c}") for c in ("nodes", "links", "length_mm")),
        F.max(F.when(F.col("r") == 1, F.struct("highway_links", "nodes"))).alias("a"),
        F.max(F.when(F.col("r") == 2, F.struct("highway_links", "nodes"))).alias("b"),
    )
    close = (F.col("a.highway_links") == F.col("b.highway_links")) & (F.greatest("a.nodes", "b.nodes") < 2 * F.greatest(F.least("a.nodes", "b.nodes"), F.lit(1)))
    return by.select(
        F.col("g").alias("closure_group_id"),
        "parts",
        (F.col("separated_links") > 0).alias("physically_isolates"),
        "separated_nodes",
        "separated_links",
        "separated_length_mm",
        (F.coalesce(close, F.lit(False)) & (F.col("separated_links") > 0)).alias("ambiguous"),
    )
