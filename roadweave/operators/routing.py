"""Shortest paths in bulk.

A snapshot's graph is small beside the work asked of it (every closure, profile and metric), so the
arcs are laid out as flat arrays by node, once their number is checked, and broadcast; the requests
are what is distributed. The Python workers of an executor map the same arrays, and search many
requests at once (``search``). A request's search runs from both ends, so a dead end is exhausted
from its own side and the answer "no route" costs what the smaller side does; requests for many
targets share one search for each source. A budget of visited nodes turns into UNRESOLVED_TIMEOUT, never into
DISCONNECTED.

A path that makes a banned turn is not an answer: the request is searched again over the graph whose
nodes are arcs, where banned turns have no edge, and marked as such."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from . import search
from .layout import mapped, ship

#: Arcs up to which a graph is broadcast (about 45 bytes each, laid out).
MAX_ARCS = 20_000_000
OK, DISCONNECTED, TIMEOUT, UNSUPPORTED, TURN = "OK", "DISCONNECTED", "UNRESOLVED_TIMEOUT", "UNSUPPORTED_PROFILE", "TURN_RESTRICTION_UNSUPPORTED"
#: Column that admits a profile's traffic, and the one that is a metric's cost.
PROFILES = {"car": "mode_car", "heavy": "mode_heavy", "emergency": None}
METRICS = {"distance": "cost_mm", "time": "cost_ms"}
#: Profiles that banned turns bind.
BOUND = ("car", "heavy")
BUDGET = search.BUDGET


def scan_edges(arcs: DataFrame, profile: str = "car", metric: str = "distance", excluded: DataFrame | None = None) -> DataFrame:
    """(id, source, target, cost, reverse_cost) of the arcs a profile may use, with a known cost and
    not excluded; direction is in the rows, so the reverse cost is always -1."""
    if profile not in PROFILES:
        raise ValueError(f"{UNSUPPORTED}: {profile}")
    cost = METRICS[metric]
    a = arcs.where(F.col(cost).isNotNull())
    if PROFILES[profile]:
        a = a.where(PROFILES[profile])
    if excluded is not None:
        a = a.join(excluded.select("arc_id"), "arc_id", "left_anti")
    return a.select(F.col("arc_id").alias("id"), "source", "target", F.col(cost).alias("cost"), F.lit(-1).cast("long").alias("reverse_cost"))


def checked_overlay(rows: DataFrame) -> DataFrame:
    """Arcs that exist for one request: (id, source, target, cost, reverse_cost). A cost that is no
    number, infinite or negative fails the request."""
    sound = F.coalesce(~F.isnan("cost") & (F.col("cost") >= 0) & (F.col("cost") < float("inf")), F.lit(False))
    cost = F.when(sound, F.col("cost")).otherwise(F.raise_error(F.concat(F.lit("overlay arc with an unusable cost: "), F.col("id").cast("string"))).cast("double"))
    return rows.select("id", "source", "target", cost.alias("cost"), F.lit(-1.0).alias("reverse_cost"))


def scan_overlay(spark: SparkSession, pieces: list[tuple[int, int, int, float]]) -> DataFrame:
    """The same of rows given in the request."""
    return checked_overlay(spark.createDataFrame(pieces, "id long, source long, target long, cost double"))


def _csr(node: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(node, kind="stable")
    return order, np.concatenate(([0], np.cumsum(np.bincount(node, minlength=n))))


@dataclass
class Graph:
    """One request at a time over the same layout: the plain version of ``search.Graph``, which tests
    compare it with. Arcs go by their place in the order of source and id."""

    nodes: dict[int, int]
    names: array
    arc: array
    link: array
    group: array
    tail: array
    head: array
    cost_of: array
    out_at: array
    into_at: array
    into: array
    bans: dict[int, set[int]]
    long_bans: list[list[int]]

    @staticmethod
    def of(arc: np.ndarray, link: np.ndarray, source: np.ndarray, target: np.ndarray, cost: np.ndarray, group: np.ndarray, bans: list[list[int]] | None = None) -> Graph:
        ids = np.unique(np.concatenate([source, target]))
        s, t = np.searchsorted(ids, source), np.searchsorted(ids, target)
        order = np.lexsort((arc, s))
        arc, link, s, t, cost, group = (x[order] for x in (arc, link, s, t, cost, group))
        _, out_at = _csr(s, len(ids))
        into, into_at = _csr(t, len(ids))
        pairs: dict[int, set[int]] = {}
        for b in bans or []:
            if len(b) == 2:
                pairs.setdefault(b[0], set()).add(b[1])
        q = lambda x: array("q", np.ascontiguousarray(x, np.int64).tobytes())
        return Graph(dict(zip(ids.tolist(), range(len(ids)), strict=True)), q(ids), q(arc), q(link), q(group), q(s), q(t), q(cost), q(out_at), q(into_at), q(into), pairs, [b for b in bans or [] if len(b) > 2])

    def search(self, source: int, target: int, banned: int | None = None, budget: int = BUDGET) -> tuple[str, int | None, list[int]]:
        """Status, cost and arcs (by place) of a cheapest path without arcs of a banned group."""
        if source == target:
            return OK, 0, []
        s, t = self.nodes.get(source), self.nodes.get(target)
        if s is None or t is None:
            return DISCONNECTED, None, []
        near: tuple[dict[int, int], dict[int, int]] = ({s: 0}, {t: 0})
        via: tuple[dict[int, int], dict[int, int]] = ({}, {})
        heaps: tuple[list, list] = ([(0, s)], [(0, t)])
        done: tuple[set[int], set[int]] = (set(), set())
        cost_of, group = self.cost_of, self.group
        best = meet = None
        visited = 0
        while heaps[0] and heaps[1]:
            if best is not None and heaps[0][0][0] + heaps[1][0][0] >= best:
                break
            side = 0 if len(heaps[0]) <= len(heaps[1]) else 1
            d, n = heapq.heappop(heaps[side])
            if n in done[side]:
                continue
            done[side].add(n)
            visited += 1
            if visited > budget:
                return TIMEOUT, None, []
            mine, other, how = near[side], near[1 - side], via[side]
            if side == 0:
                places, far = range(self.out_at[n], self.out_at[n + 1]), self.head
            else:
                places, far = self.into[self.into_at[n] : self.into_at[n + 1]], self.tail
            for k in places:
                if group[k] == banned:
                    continue
                m, e = far[k], d + cost_of[k]
                if e < mine.get(m, e + 1):
                    mine[m], how[m] = e, k
                    heapq.heappush(heaps[side], (e, m))
                    if m in other and (best is None or e + other[m] < best):
                        best, meet = e + other[m], m
        if meet is None:
            return DISCONNECTED, None, []
        path, n = [], meet
        while n != s:
            path.append(via[0][n])
            n = self.tail[path[-1]]
        path.reverse()
        n = meet
        while n != t:
            path.append(via[1][n])
            n = self.head[path[-1]]
        return OK, best, path

    def cost(self, source: int, target: int, banned: int | None = None, budget: int = BUDGET) -> tuple[str, int | None]:
        return self.search(source, target, banned, budget)[:2]

    def search_turns(self, source: int, target: int, banned: int | None = None, budget: int = BUDGET) -> tuple[str, int | None, list[int]]:
        """The same over arcs as nodes: no banned turn, no turning back on a link."""
        if source == target:
            return OK, 0, []
        s, t = self.nodes.get(source), self.nodes.get(target)
        if s is None or t is None:
            return DISCONNECTED, None, []
        near, via, done, heap = {}, {}, set(), []
        for k in range(self.out_at[s], self.out_at[s + 1]):
            if self.group[k] != banned:
                near[k] = self.cost_of[k]
                heap.append((near[k], k))
        heapq.heapify(heap)
        while heap:
            d, k = heapq.heappop(heap)
            if k in done:
                continue
            done.add(k)
            if len(done) > budget:
                return TIMEOUT, None, []
            n = self.head[k]
            if n == t:
                path = [k]
                while path[-1] in via:
                    path.append(via[path[-1]])
                return OK, d, path[::-1]
            no = self.bans.get(self.link[k], ())
            for j in range(self.out_at[n], self.out_at[n + 1]):
                if self.link[j] == self.link[k] or self.link[j] in no or self.group[j] == banned:
                    continue
                e = d + self.cost_of[j]
                if e < near.get(j, e + 1):
                    near[j], via[j] = e, k
                    heapq.heappush(heap, (e, j))
        return DISCONNECTED, None, []

    def links_of(self, path: list[int]) -> list[int]:
        """Links in the order passed, each once in a row."""
        out: list[int] = []
        for k in path:
            if not out or out[-1] != self.link[k]:
                out.append(self.link[k])
        return out

    def violates(self, links: list[int], pairs_too: bool = True) -> bool:
        if pairs_too and self.bans and any(b in self.bans.get(a, ()) for a, b in zip(links, links[1:], strict=False)):
            return True
        return any(links[i : i + len(b)] == b for b in self.long_bans for i in range(len(links) - len(b) + 1))

    def route(self, source: int, target: int, banned: int | None = None, budget: int = BUDGET) -> tuple[str, int | None, list[int], bool]:
        """Status, cost, arcs and whether the search over arcs was needed. Bans of more than two
        links have no edge to leave out: a path that still makes one is unsupported."""
        status, cost, path = self.search(source, target, banned, budget)
        if status != OK or not self.violates(self.links_of(path)):
            return status, cost, path, False
        status, cost, path = self.search_turns(source, target, banned, budget)
        if status == OK and self.violates(self.links_of(path), False):
            return TURN, None, [], True
        return status, cost, path, True

    def tree(self, source: int, targets: set[int] | None = None, budget: int = BUDGET) -> tuple[str, dict[int, int], dict[int, int]]:
        """Costs by node, and the arc each is reached by (of equally good ones the least id), from
        one source: of all nodes, or until the targets are settled."""
        s = self.nodes.get(source)
        if s is None:
            return OK, {}, {}
        left = None if targets is None else {self.nodes[t] for t in targets if t in self.nodes}
        best, via, done, heap = {s: 0}, {}, set(), [(0, s)]
        while heap and (left is None or left):
            d, n = heapq.heappop(heap)
            if n in done:
                continue
            done.add(n)
            if len(done) > budget:
                return TIMEOUT, {}, {}
            if left is not None:
                left.discard(n)
            for k in range(self.out_at[n], self.out_at[n + 1]):
                m, e = self.head[k], d + self.cost_of[k]
                now = best.get(m)
                if now is None or e < now:
                    best[m], via[m] = e, k
                    heapq.heappush(heap, (e, m))
                elif e == now and m in via and self.arc[k] < self.arc[via[m]]:
                    via[m] = k
        return OK, best, via

    def path_back(self, via: dict[int, int], source: int, target: int) -> list[int]:
        out, n, s = [], self.nodes[target], self.nodes[source]
        while n != s:
            out.append(via[n])
            n = self.tail[out[-1]]
        return out[::-1]


_GRAPHS: dict[str, search.Graph] = {}


def laid_out(key: str, shared) -> search.Graph:  # noqa: ANN001
    """One graph for each worker process, its arrays in pages common to all of an executor; tasks
    reach it through this module, as functions that are shipped bring their own copy of what they
    close over."""
    if key not in _GRAPHS:
        _GRAPHS.clear()
        _GRAPHS[key] = search.Graph.of(*mapped(shared))
    return _GRAPHS[key]


def share(edges: DataFrame, group: str | None = None, bans: DataFrame | None = None, more: tuple[str, ...] = (), places: DataFrame | None = None) -> tuple:
    """Lays out and broadcasts the edges (id, source, target, cost, and link_id where they have it)
    after a check of their number; ``group`` is the column that closures ban, ``bans`` are link
    sequences, ``more`` further numbers of edges, -1 for none, and ``places(node_id, x, y)`` where
    nodes are."""
    n = edges.count()
    if n > MAX_ARCS:
        raise ValueError(f"{n} arcs are more than the {MAX_ARCS} that a worker lays out; part the network by component")
    long = lambda c, name: c.cast("long").alias(name)
    columns = ["id", "source", "target", "cost"]
    beside = [long(F.col("link_id"), "l")] if "link_id" in edges.columns else []
    beside += [long(F.col(group), "g")] if group else []
    t = edges.select(*columns, *beside, *(F.coalesce(F.col(c), F.lit(-1)).cast("long").alias(f"m_{c}") for c in more)).toArrow()
    a = {c: t.column(c).to_numpy() for c in t.column_names}
    del t
    sequences = [list(r.seq) for r in bans.select("seq").collect()] if bans is not None else []
    arrays, rest = search.Graph.lay_out(a["id"], a.get("l", a["id"]), a["source"], a["target"], a["cost"], a.get("g", np.zeros(n, np.int64)), sequences, {c: a[f"m_{c}"] for c in more})
    if places is not None:
        p = places.select("node_id", F.col("x").cast("double"), F.col("y").cast("double")).toArrow()
        ids = p.column(0).to_numpy()
        order = np.argsort(ids)
        at = order[np.minimum(np.searchsorted(ids[order], arrays["names"]), len(ids) - 1)] if len(ids) else ids
        for k, c in enumerate("xy", 1):
            arrays[f"more {c}"] = np.where(ids[at] == arrays["names"], p.column(k).to_numpy()[at], np.nan)
    return ship(edges.sparkSession.sparkContext, arrays, rest)


def ban_sequences(restrictions: DataFrame) -> DataFrame:
    return restrictions.select(F.array("from_link", "to_link").alias("seq"))


def _spread(requests: DataFrame) -> DataFrame:
    return requests.repartition(requests.sparkSession.sparkContext.defaultParallelism * 4)


#: Requests of a task that are searched in one go.
LOT = 1 << 15


def _lots(batches: Iterator[pa.RecordBatch], rows: int = LOT) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _lists(ends: np.ndarray, values: np.ndarray, there: np.ndarray) -> pa.Array:
    """Lists of longs between offsets, null where there is none."""
    offsets = pa.array(ends, pa.int32(), mask=np.append(~there, False))
    return pa.ListArray.from_arrays(offsets, pa.array(values, pa.int64()))


def route(requests: DataFrame, edges: DataFrame, group: str | None = None, bans: DataFrame | None = None, budget: int = BUDGET, ways: bool = True) -> DataFrame:
    """``requests(source, target, banned, ...)`` -> their rows with status, cost, arcs, links (unless
    ``ways`` are not asked for) and exact (the search over arcs was needed). banned is a value of the
    edges' ``group`` column, or null for the intact graph."""
    shared, key = share(edges, group, bans)
    names = [*requests.columns, "status", "cost", *(("arcs", "links") if ways else ()), "exact"]
    kinds = np.array([OK, DISCONNECTED, TIMEOUT, TURN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = laid_out(key, shared)
        for b in _lots(batches):
            s, t = b.column("source").to_numpy(), b.column("target").to_numpy()
            x = b.column("banned").cast(pa.int64())
            closed = x.is_valid().to_numpy()
            ban = np.where(closed, graph.group_of(x.fill_null(0).to_numpy()), -1)
            status, cost, ends, path, again, unsound = search.routes(graph, graph.nodes(s), graph.nodes(t), ban, budget)
            # a place that no arc meets is still where it is
            status, cost = np.where(s == t, search.FOUND, status), np.where(s == t, 0, cost)
            status = np.where(unsound, 3, status)
            found = status == search.FOUND
            new = [pa.array(kinds[status], pa.string()), pa.array(cost, pa.int64(), mask=~found)]
            if ways:
                who = np.repeat(np.arange(len(s)), np.diff(ends))
                link = graph.links[graph.link[path]]
                first = np.ones(len(path), bool)
                first[1:] = (who[1:] != who[:-1]) | (link[1:] != link[:-1])
                passed = np.concatenate(([0], np.cumsum(np.bincount(who[first], minlength=len(s)))))
                new += [_lists(ends, graph.arc[path], found), _lists(passed, link[first], found)]
            new.append(pa.array(again, pa.bool_()))
            yield from pa.Table.from_arrays([*b.columns, *new], names=names).to_batches(10_000)

    longs = ArrayType(LongType())
    lists = [StructField("arcs", longs), StructField("links", longs)] if ways else []
    schema = StructType([*requests.schema.fields, StructField("status", StringType()), StructField("cost", LongType()), *lists, StructField("exact", BooleanType())])
    return _spread(requests).mapInArrow(run, schema)


def route_costs(requests: DataFrame, edges: DataFrame, group: str, budget: int = BUDGET) -> DataFrame:
    """``requests(source, target, banned, ...)`` -> their rows with status and cost, without bans."""
    return route(requests, edges, group, None, budget, False).drop("exact")


def group_number(group: str | Column) -> Column:
    """Closure groups by number, so that what is broadcast and compared is narrow."""
    return F.xxhash64(group)


def detours(links: DataFrame, arcs: DataFrame, profile: str = "car", metric: str = "distance", only: DataFrame | None = None, restrictions: DataFrame | None = None, scope: str = "link", budget: int = BUDGET) -> DataFrame:
    """For each permitted direction of each link: the intact cost, the cost with the closure in
    force, what is added, the penalty, the ratio to the link, and the status. ``added`` may be
    negative (another way was shorter anyway); the penalty is against the cheapest intact way.

    ``scope`` says what closing a link removes: the ``physical`` road (all links of its closure
    group), the ``link``, or the one ``directed`` arc. ``only`` has the link_ids to close; by default
    every link is closed in turn. A link that ends where it starts is a source data error."""
    edges = scan_edges(arcs, profile, metric).withColumnRenamed("id", "arc_id")
    column = {"physical": group_number("closure_group_id"), "link": F.col("link_id"), "directed": F.col("arc_id")}[scope]
    known = arcs.select("arc_id", "link_id", column.alias("ban"))
    edges = edges.join(known, "arc_id").withColumnRenamed("arc_id", "id")
    own = edges.select(F.col("id").alias("arc_id"), "link_id", F.col("cost").alias("length"), "source", "target", "ban")
    if only is not None:
        own = own.join(only.select("link_id"), "link_id", "left_semi")
    ask = own.select("arc_id", "link_id", "length", "source", "target", F.explode(F.array(F.lit(None).cast("long"), F.col("ban"))).alias("banned"))
    bans = ban_sequences(restrictions) if restrictions is not None and profile in BOUND else None
    got = route(ask, edges, "ban", bans, budget, False)
    closed = F.col("banned").isNotNull()
    pick = lambda c: F.max(F.when(closed, F.col(c)))
    whole = got.groupBy("arc_id", "link_id", "length").agg(
        F.max(F.when(~closed, F.col("cost"))).alias("normal"), pick("cost").alias("alternative"), pick("status").alias("status"), F.bool_or("exact").alias("turn_aware"), F.max(F.col("source") == F.col("target")).alias("loop")
    )
    answer = lambda c: F.when(~F.col("loop"), c)
    return whole.select(
        "link_id",
        (F.col("arc_id") % 2).cast("int").alias("direction"),
        "length",
        answer(F.col("normal")).alias("normal"),
        answer(F.col("alternative")).alias("alternative"),
        answer(F.col("alternative") - F.col("length")).alias("added"),
        answer(F.col("alternative") - F.col("normal")).alias("penalty"),
        answer(F.when(F.col("length") > 0, F.round(F.col("alternative") / F.col("length"), 3))).alias("ratio"),
        F.when(F.col("loop"), "SOURCE_DATA_ERROR").otherwise(F.col("status")).alias("status"),
        "turn_aware",
    )


def _chunks(names: list[str], columns: list[pa.Array], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    return iter(pa.Table.from_arrays(columns, names=names).to_batches(rows))


def tree_costs(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """``sources(source)`` -> (source, node, cost) of every node each source reaches: one search
    serves all targets of a source, and sources are what is distributed."""
    shared, key = share(edges if "id" in edges.columns else edges.withColumn("id", F.lit(0).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = laid_out(key, shared)
        for b in batches:
            for s in b.column(0).to_pylist():
                at = int(graph.nodes(np.array([s]))[0])
                nodes, costs = np.array([s]), np.array([0])
                if at >= 0:
                    dist = graph.tree(at)[1]
                    met = np.flatnonzero(dist < search.FAR)
                    nodes, costs = graph.names[met], dist[met]
                yield from _chunks(["source", "node", "cost"], [pa.array(np.full(len(nodes), s), pa.int64()), pa.array(nodes, pa.int64()), pa.array(costs, pa.int64())])

    return _spread(sources.select(F.col("source").cast("long"))).mapInArrow(run, "source long, node long, cost long")


def turn_costs(firsts: DataFrame, edges: DataFrame, bans: DataFrame | None = None) -> DataFrame:
    """``firsts(arc)`` -> (arc, last, cost) of every arc each arc leads to by permitted turns, without
    its own cost: the graph whose nodes are arcs, whose edges are never written out."""
    shared, key = share(edges, None, bans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = laid_out(key, shared)
        for b in batches:
            for s in b.column(0).to_pylist():
                for at in np.flatnonzero(graph.arc == s).tolist():
                    dist = graph.tree(at, turns=True)[1]
                    met = np.flatnonzero(dist < search.FAR)
                    yield from _chunks(["arc", "last", "cost"], [pa.array(np.full(len(met), s), pa.int64()), pa.array(graph.arc[met], pa.int64()), pa.array(dist[met], pa.int64())])

    return _spread(firsts.select(F.col("arc").cast("long"))).mapInArrow(run, "arc long, last long, cost long")


#: Arcs of the ways that are written in one batch.
WAY_ARCS = 1 << 20


def many_paths(pairs: DataFrame, edges: DataFrame, budget: int | None = BUDGET, links: bool = False, total: str | None = None) -> DataFrame:
    """``pairs(source, target)`` -> status, cost and arcs (or links, each once in a row) of each, and
    the ``total`` of a further column (null if any arc has none), one search for each source and
    task. A pair without a path is DISCONNECTED only if its search ended; a search stopped by its
    budget leaves all its pairs unresolved."""
    shared, key = share(edges, more=(total,) if total else ())
    names = ["source", "target", "status", "cost", "links" if links else "arcs", *([total] if total else [])]
    kinds = np.array([OK, DISCONNECTED, TIMEOUT], object)

    def of_source(graph: search.Graph, s: int, targets: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, to = int(graph.nodes(np.array([s]))[0]), graph.nodes(targets)
        state, dist, via = (search.FOUND, np.empty(0), np.empty(0, np.int32)) if at < 0 else graph.tree(at, to[to >= 0] if (to >= 0).any() else np.array([at]), budget=budget)
        met = (to >= 0) & (at >= 0)
        met[met] = dist[to[met]] < search.FAR
        deep = graph.levels(via)
        n = np.zeros(len(to), np.int64)
        n[met] = deep[to[met]]
        if total and len(via):
            one = np.where(via >= 0, graph.more[total][via], 0)
            unknown, sums = graph.fold(via, (one < 0).astype(np.int64)), graph.fold(via, np.maximum(one, 0))
        for part in np.split(np.arange(len(to)), np.flatnonzero(np.diff(np.cumsum(n) // WAY_ARCS)) + 1):
            ok, ends = met[part], np.concatenate(([0], np.cumsum(n[part])))
            _, path = graph.paths(via, deep, to[part][ok])
            same = targets[part] == s
            status = np.where(same, search.FOUND, state if state != search.FOUND else np.where(ok, search.FOUND, search.NONE))
            found = status == search.FOUND
            cost = np.zeros(len(part), np.int64)
            cost[ok] = dist[to[part][ok]]
            passed = graph.arc[path]
            if links:
                passed = graph.links[graph.link[path]]
                who = np.repeat(np.arange(len(part)), n[part])
                first = np.ones(len(path), bool)
                first[1:] = (who[1:] != who[:-1]) | (passed[1:] != passed[:-1])
                ends, passed = np.concatenate(([0], np.cumsum(np.bincount(who[first], minlength=len(part))))), passed[first]
            columns = [pa.array(np.full(len(part), s), pa.int64()), pa.array(targets[part], pa.int64()), pa.array(kinds[status], pa.string()), pa.array(cost, pa.int64(), mask=~found), _lists(ends, passed, found)]
            if total:
                known, value = found & ~ok, np.zeros(len(part), np.int64)
                known[ok], value[ok] = unknown[to[part][ok]] == 0, sums[to[part][ok]]
                columns.append(pa.array(value, pa.int64(), mask=~known))
            yield from _chunks(names, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = laid_out(key, shared)
        for b in _lots(batches, 1 << 62):
            s, t = b.column(0).to_numpy(), b.column(1).to_numpy()
            for one in np.split(np.arange(len(s)), np.flatnonzero(np.diff(s)) + 1):
                yield from of_source(graph, int(s[one[0]]), t[one])

    asked = pairs.select(F.col("source").cast("long"), F.col("target").cast("long"))
    # ranges of equal size: a source of very many targets is searched once for each that holds some
    dealt = asked.repartitionByRange(asked.sparkSession.sparkContext.defaultParallelism * 4, "source", F.xxhash64("target")).sortWithinPartitions("source", "target")
    return dealt.mapInArrow(run, f"source long, target long, status string, cost long, {names[4]} array<long>" + (f", {total} long" if total else ""))


def tree_measures(sources: DataFrame, edges: DataFrame, measure: Callable[[search.Graph, int, np.ndarray, np.ndarray], dict], columns: str, **shared_too: object) -> DataFrame:
    """``sources(source)`` -> (source, target, ...) of every other node each source reaches, with what
    ``measure(graph, start, costs, last arcs)`` finds for all nodes at once: what can be told of a way
    from the way to the node before needs no way written out."""
    shared, key = share(edges, **shared_too)
    names = ["source", "target", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = laid_out(key, shared)
        for b in batches:
            for s in b.column(0).to_pylist():
                at = int(graph.nodes(np.array([s]))[0])
                if at < 0:
                    continue
                _, dist, via = graph.tree(at)
                met = np.flatnonzero(via >= 0)
                found = measure(graph, at, dist, via)
                rows = [np.full(len(met), s), graph.names[met], *(found[c][met] for c in names[2:])]
                yield from _chunks(names, [pa.array(x) for x in rows])

    return _spread(sources.select(F.col("source").cast("long"))).mapInArrow(run, f"source long, target long, {columns}")


def summarise(paths: DataFrame, arcs: DataFrame, keys: list[str]) -> DataFrame:
    """Of each path (``keys`` and arcs): its distance, its time (null if any arc has none), and its
    links, each once in a row. An arc that is not in the network fails, rather than to be left out
    of a total."""
    steps = paths.where("arcs is not null").select(*keys, F.posexplode("arcs").alias("place", "arc_id"))
    met = steps.join(arcs.select("arc_id", "link_id", "cost_mm", "cost_ms", F.lit(True).alias("known")), "arc_id", "left")
    known = F.when(F.col("known"), F.col("link_id")).otherwise(F.raise_error(F.concat(F.lit("unknown arc: "), F.col("arc_id").cast("string"))).cast("long"))
    by = met.withColumn("link_id", known).groupBy(*keys).agg(
        F.sum("cost_mm").alias("distance_mm"),
        F.when(F.count("cost_ms") == F.count("*"), F.sum("cost_ms")).alias("time_ms"),
        F.transform(F.array_sort(F.collect_list(F.struct("place", "link_id"))), lambda s: s.link_id).alias("l"),
    )
    links = F.expr("filter(l, (x, i) -> i = 0 OR l[i - 1] <> x)")
    empty = paths.where("size(arcs) = 0").select(*keys, F.lit(0).cast("long").alias("distance_mm"), F.lit(0).cast("long").alias("time_ms"), F.array().cast("array<bigint>").alias("links"))
    return by.select(*keys, "distance_mm", "time_ms", links.alias("links")).unionByName(empty)


def ports(links: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entry and exit arcs of each closure group: arcs of other groups that end, or start, at one of
    its nodes. (g, arc_id, link_id, node, outside)"""
    g = F.col("closure_group_id")
    inside = links.select(g.alias("g"), F.explode(F.array("source", "target")).alias("node")).distinct()

    def side(here: str, there: str) -> DataFrame:
        a = arcs.select("arc_id", "link_id", g.alias("own"), F.col(here).alias("node"), F.col(there).alias("outside"))
        return inside.join(a, "node").where("own <> g").drop("own")

    return side("target", "source"), side("source", "target")


#: Ports of each side that are paired, so a closure never makes more than four hundred pairs.
MAX_PORTS = 20


def port_pairs(links: DataFrame, arcs: DataFrame, most: int = MAX_PORTS) -> tuple[DataFrame, DataFrame]:
    """The pairs of entry and exit ports of each piece of each closure group, the first ``most`` of
    each side by arc id, and what that bound left out: entries, exits, omitted_entries,
    omitted_exits, omitted_pairs, truncated. Ports on separate pieces of a closure make no pair."""
    from pyspark.sql import Window

    from .connectivity import group_pieces

    pieces = group_pieces(links)
    sides = []
    for df, name in zip(ports(links, arcs), ("entry", "exit"), strict=True):
        w = Window.partitionBy("g", "piece").orderBy("arc_id")
        ranked = df.join(pieces, ["g", "node"]).withColumn("r", F.row_number().over(w))
        sides.append(ranked.select("g", "piece", "r", *(F.col(c).alias(f"{name}_{c}") for c in ("arc_id", "link_id", "node", "outside"))))
    pairs = sides[0].where(F.col("r") <= most).drop("r").join(sides[1].where(F.col("r") <= most).drop("r"), ["g", "piece"])
    count = [s.groupBy("g").agg(F.count("*").alias(n), F.count_if(F.col("r") <= most).alias(f"kept_{n}")) for s, n in zip(sides, ("entries", "exits"), strict=True)]
    made = pairs.groupBy("g").agg(F.count("*").alias("pairs"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    whole = count[0].join(count[1], "g", "full").join(made, "g", "left").select("g", *(n(c).alias(c) for c in ("entries", "exits", "kept_entries", "kept_exits", "pairs")))
    left_out = whole.select(
        "g", "entries", "exits", "pairs", (F.col("entries") - F.col("kept_entries")).alias("omitted_entries"), (F.col("exits") - F.col("kept_exits")).alias("omitted_exits"), (F.col("entries") * F.col("exits") - F.col("pairs")).alias("omitted_pairs")
    )
    return pairs, left_out.withColumn("truncated", F.col("omitted_entries") + F.col("omitted_exits") > 0)


def movements(links: DataFrame, arcs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Every pair of ports of every closure group with the reason why it is, or is not, a through
    movement that the closure interrupts, and with its intact and replacement cost.

    A pair is one if the cheapest intact way between the two closure nodes uses the closure, that is
    if every way without it is dearer: ways that cost the same make the closure unnecessary."""
    edges = scan_edges(arcs).withColumnRenamed("id", "arc_id").join(arcs.select("arc_id", "link_id", group_number("closure_group_id").alias("ban")), "arc_id").withColumnRenamed("arc_id", "id")
    car = arcs.where("mode_car")
    pairs, _ = port_pairs(links, car)
    ask = pairs.where("entry_node <> exit_node").select("g", F.col("entry_node").alias("source"), F.col("exit_node").alias("target")).distinct()
    ask = ask.withColumn("banned", F.explode(F.array(F.lit(None).cast("long"), group_number("g"))))
    got = route(ask, edges, "ban", None, budget)
    closed = F.col("banned").isNotNull()
    pick = lambda c, on: F.max(F.when(on, F.col(c)))
    by = got.groupBy("g", F.col("source").alias("entry_node"), F.col("target").alias("exit_node")).agg(
        pick("cost", ~closed).alias("intact"),
        pick("cost", closed).alias("replacement"),
        F.bool_or(F.col("status") == TIMEOUT).alias("unresolved"),
        F.max(F.when(~closed, F.element_at("arcs", 1))).alias("first"),
        F.max(F.when(~closed, F.element_at("arcs", -1))).alias("last"),
        F.max(F.when(closed, F.col("links"))).alias("replacement_links"),
    )
    ends = arcs.select(F.col("arc_id"), F.col("link_id"), F.col("source"), F.col("target"))
    first = ends.select(F.col("arc_id").alias("first"), F.col("link_id").alias("first_link"), F.col("target").alias("first_to"))
    last = ends.select(F.col("arc_id").alias("last"), F.col("link_id").alias("last_link"), F.col("source").alias("last_from"))
    by = by.join(first, "first", "left").join(last, "last", "left")
    m = pairs.join(by, ["g", "entry_node", "exit_node"], "left")
    back = (F.col("first_link") == F.col("entry_link_id")) & (F.col("first_to") == F.col("entry_outside"))
    forth = (F.col("last_link") == F.col("exit_link_id")) & (F.col("last_from") == F.col("exit_outside"))
    reason = (
        F.when((F.col("entry_link_id") == F.col("exit_link_id")) & (F.col("entry_node") == F.col("exit_node")), "U_TURN_AT_BOUNDARY")
        .when(F.col("entry_node") == F.col("exit_node"), "DOES_NOT_TRAVERSE_CLOSURE")
        .when(F.col("unresolved"), "SEARCH_UNRESOLVED")
        .when(F.col("intact").isNull(), "NO_INTACT_ROUTE")
        .when(F.coalesce(back | forth, F.lit(False)), "U_TURN_IN_ROUTE")
        .when(F.coalesce(F.col("replacement") == F.col("intact"), F.lit(False)), "DOES_NOT_TRAVERSE_CLOSURE")
        .otherwise("THROUGH_MOVEMENT")
    )
    return m.select(F.col("g").alias("closure_group_id"), F.col("entry_arc_id").alias("entry_arc"), F.col("exit_arc_id").alias("exit_arc"), "entry_node", "exit_node", "intact", "replacement", "replacement_links", reason.alias("reason"))


def replacements(moves: DataFrame, restrictions: DataFrame) -> DataFrame:
    """The replacement of each through movement: penalty, ratio and status. A way that makes a
    banned turn is no detour to offer, and no finding that there is none either."""
    through = moves.where("reason = 'THROUGH_MOVEMENT'")
    steps = through.where("replacement_links is not null").select("closure_group_id", "entry_node", "exit_node", "replacement_links").distinct()
    turns = steps.select("closure_group_id", "entry_node", "exit_node", F.explode(F.expr("if(size(replacement_links) < 2, array(), transform(sequence(0, size(replacement_links) - 2), i -> struct(replacement_links[i] AS from_link, replacement_links[i + 1] AS to_link)))").cast("array<struct<from_link:bigint,to_link:bigint>>")).alias("t"))
    bad = turns.select("closure_group_id", "entry_node", "exit_node", "t.from_link", "t.to_link").join(restrictions, ["from_link", "to_link"], "left_semi").select("closure_group_id", "entry_node", "exit_node").distinct().withColumn("banned", F.lit(True))
    r = through.join(bad, ["closure_group_id", "entry_node", "exit_node"], "left")
    status = F.when(F.col("replacement").isNull(), DISCONNECTED).when(F.col("banned"), TURN).otherwise(OK)
    return r.select("closure_group_id", "entry_arc", "exit_arc", "intact", "replacement", (F.col("replacement") - F.col("intact")).alias("penalty"), F.round(F.col("replacement") / F.col("intact"), 3).alias("ratio"), status.alias("status"))
