"""Fixpoints and shortest paths on road graphs.

Whole-graph fixpoints are checkpointed rounds of joins and aggregations.
Many-source searches run one search for each source in the tasks, on arrays of
a graph that is sent only after a count of its edges; larger graphs are
searched by rounds of joins.
"""

from __future__ import annotations

import heapq
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.components import connected_components, contracted_components

#: Edges of a graph that may be sent to every task: 12 bytes each there, and 24 in the driver.
MOST_SENT = 5_000_000


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage in the session's shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="wayfold-checkpoint-"))
    # columns take a fifth of the disk that a checkpoint's rows take, and readers skip those that they don't need
    path = f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node), size."""
    found = contracted_components(links.select("a", "b"), checkpoint=checkpointed)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return found.join(sizes, "component").select("node", "component", "size")


def large_components(found: DataFrame, least: int) -> DataFrame:
    """The largest component and those of ``least`` nodes or more."""
    top = found.agg(F.max(F.struct("size", (-F.col("component")).alias("c"))).alias("m")).select((-F.col("m.c")).alias("top"))
    return found.join(F.broadcast(top)).where((F.col("size") >= least) | (F.col("component") == F.col("top"))).drop("top")


def bridges(links: DataFrame) -> DataFrame:
    """a, b of links whose removal parts their component; parallel links count as one.

    Leaves are peeled in rounds first (each peeled link is a bridge), which
    takes dead ends away at any scale; what is left of each component is
    searched by one task's iterative depth-first search.
    """
    edges = checkpointed(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found, total = None, edges.count()
    while total:
        ends = edges.select(F.col("a").alias("n")).unionAll(edges.select(F.col("b").alias("n")))
        leaves = ends.groupBy("n").agg(F.count(F.lit(1)).alias("d")).where("d = 1").select("n")
        marked = edges.join(leaves.select(F.col("n").alias("a"), F.lit(True).alias("la")), "a", "left").join(leaves.select(F.col("n").alias("b"), F.lit(True).alias("lb")), "b", "left")
        marked = checkpointed(marked.select("a", "b", F.coalesce("la", "lb", F.lit(False)).alias("leaf")))
        peeled = marked.where("leaf").select("a", "b")
        found = peeled if found is None else found.unionAll(peeled)
        edges = marked.where("NOT leaf").select("a", "b")
        rest = edges.count()
        if rest == total:
            break
        total = rest
    core = connected_components(edges, checkpoint=checkpointed)
    keyed = edges.join(core.select(F.col("node").alias("a"), "component"), "a")
    inner = keyed.groupBy("component").applyInPandas(_core_bridges, "a long, b long")
    return inner if found is None else found.unionAll(inner)


def _core_bridges(rows: pd.DataFrame) -> pd.DataFrame:
    near: dict[int, list[int]] = {}
    for a, b in zip(rows["a"].tolist(), rows["b"].tolist(), strict=True):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    seen: dict[int, int] = {}
    low: dict[int, int] = {}
    out = []
    for root in near:
        if root in seen:
            continue
        seen[root] = low[root] = len(seen)
        stack = [(root, -1, iter(near[root]))]
        while stack:
            node, parent, rest = stack[-1]
            for other in rest:
                if other not in seen:
                    seen[other] = low[other] = len(seen)
                    stack.append((other, node, iter(near[other])))
                    break
                if other != parent:
                    low[node] = min(low[node], seen[other])
            else:
                stack.pop()
                if stack:
                    low[parent] = min(low[parent], low[node])
                    if low[node] > seen[parent]:
                        out.append((min(parent, node), max(parent, node)))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def dead_ends(links: DataFrame, bridge_rows: DataFrame) -> DataFrame:
    """node, dead_end: whether a bridge parts a node from its component's largest bridgeless part."""
    simple = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    kept = simple.join(bridge_rows, ["a", "b"], "left_anti")
    nodes = simple.select(F.col("a").alias("node")).unionAll(simple.select(F.col("b").alias("node"))).distinct()
    parts = connected_components(kept, checkpoint=checkpointed)
    whole = connected_components(simple, checkpoint=checkpointed).select("node", F.col("component").alias("whole"))
    of = nodes.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).join(whole, "node").select("node", "part", "whole")
    sizes = of.groupBy("whole", "part").agg(F.count(F.lit(1)).alias("n"))
    core = sizes.groupBy("whole").agg(F.max(F.struct("n", (-F.col("part")).alias("p"))).alias("m")).select("whole", (-F.col("m.p")).alias("core"))
    return of.join(core, "whole").select("node", (F.col("part") != F.col("core")).alias("dead_end"))


def distances(edges: DataFrame, sources: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """source, node, metric: least sums of ``weight`` (from_id, to_id, weight), by frontier joins.

    Each round relaxes only the nodes that the last one bettered.
    """
    best = checkpointed(sources.select(F.col("source"), F.col("source").alias("node"), F.lit(0).cast("long").alias("metric"), F.lit(True).alias("fresh")))
    for _ in range(most_rounds):
        step = best.where("fresh").join(edges, F.col("node") == F.col("from_id")).select("source", F.col("to_id").alias("node"), (F.col("metric") + F.col("weight")).alias("metric"), F.lit(True).alias("fresh"))
        both = best.select("source", "node", "metric", F.lit(False).alias("fresh")).unionAll(step)
        # of equal metrics the known one comes first: it isn't relaxed again
        best = checkpointed(both.groupBy("source", "node").agg(F.min(F.struct("metric", "fresh")).alias("m")).select("source", "node", "m.metric", "m.fresh"))
        if best.where("fresh").isEmpty():
            return best.drop("fresh")
    raise RuntimeError("distances did not settle")


def searched(graph: dict[int, list[tuple[int, int]]], source: int, target: int | None = None, estimate: Callable[[int], int] | None = None) -> tuple[dict[int, int], dict[int, int]]:
    """(metric, predecessor) of settled nodes by Dijkstra's search, or A* with an estimate."""
    done: dict[int, int] = {}
    before: dict[int, int] = {}
    known = {source: 0}
    queue = [(estimate(source) if estimate else 0, source)]
    while queue:
        _, node = heapq.heappop(queue)
        if node in done:
            continue
        done[node] = known[node]
        if node == target:
            break
        for other, weight in graph.get(node, ()):
            new = done[node] + weight
            if other not in done and (other not in known or new < known[other] or (new == known[other] and node < before[other])):
                known[other] = new
                before[other] = node
                heapq.heappush(queue, (new + (estimate(other) if estimate else 0), other))
    return done, before


_FAR = np.iinfo(np.int64).max


@dataclass
class Network:
    """A graph as arrays: nodes in order, and each node's outgoing edges side by side."""

    nodes: np.ndarray
    starts: np.ndarray
    targets: np.ndarray
    weights: np.ndarray

    def place(self, node: int) -> int:
        at = int(np.searchsorted(self.nodes, node))
        return at if at < len(self.nodes) and self.nodes[at] == node else -1

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> Network:
        """The graph of edges from ``a`` to ``b``."""
        nodes = np.unique(np.concatenate([a, b]))
        source, target = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
        # a node's edges lie by weight, so that those beyond a bound are cut off
        order = np.lexsort((target, weight, source))
        starts = np.searchsorted(source[order], np.arange(len(nodes) + 1))
        return cls(nodes, starts, target[order].astype(np.int32), weight[order])

    def __post_init__(self) -> None:
        self.step = max(1, int(self.weights.mean()) // 4) if len(self.weights) else 1
        self.top = int(self.weights.max(initial=0)) + 1
        self.entered = np.zeros(len(self.nodes), bool)
        self.entered[self.targets] = True
        # (node, weight) of each edge as one number; none if that is too large
        owner = np.repeat(np.arange(len(self.nodes)), np.diff(self.starts))
        self.keys = owner * self.top + self.weights if len(self.nodes) * self.top < _FAR else None

    def fan(self, at: np.ndarray, room: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(edges, how many of each node) of the edges that leave some nodes, lighter than each node's ``room`` if there is one."""
        first, last = self.starts[at], self.starts[at + 1]
        if room is not None and self.keys is not None:
            last = np.searchsorted(self.keys, at.astype(np.int64) * self.top + np.clip(room, 0, self.top))
        n = last - first
        return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n), n

    def farthest(self, best: np.ndarray, source: int) -> int | None:
        """The largest metric, once every node that an edge enters has one: no edge that goes beyond it matters."""
        far = int(best[self.entered].max(initial=0))
        return None if far == _FAR else max(far, int(best[source]))

    def metrics(self, source: int) -> np.ndarray:
        """Least metric of every node from the place ``source``; negative where there is no way.

        Whole frontiers are relaxed at once, near ones first: a node goes on
        once the metrics under the current bound are settled.
        """
        best = np.full(len(self.nodes), _FAR, np.int64)
        best[source] = 0
        fresh = np.zeros(len(best), bool)
        fresh[source], bound, far = True, self.step, None
        while True:
            waiting = np.flatnonzero(fresh)
            if not len(waiting):
                return np.where(best == _FAR, -1, best)
            known = best[waiting]
            if not (ready := known <= bound).any():
                bound = int(known.min()) + self.step
                continue
            near, known = waiting[ready], known[ready]
            fresh[near] = False
            far = self.farthest(best, source)
            edges, n = self.fan(near, None if far is None else far - known)
            target, metric = self.targets[edges], np.repeat(known, n) + self.weights[edges]
            better = metric < best[target]
            target, metric = target[better], metric[better]
            np.minimum.at(best, target, metric)
            fresh[target] = True

    def tree(self, source: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(metrics, predecessors, links from the source): of equal ways the one with the least predecessor and the fewest links."""
        best, before, depth, _ = self.edge_tree(source)
        return best, before, depth

    def edge_tree(self, source: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``tree``, and the edge by which each node is reached."""
        best = self.metrics(source)
        by = np.full(len(best), -1)
        before, depth = np.full(len(best), -1), np.full(len(best), -1)
        depth[source] = 0
        now, level, far = np.array([source]), 0, int(best.max())
        while len(now):
            edges, n = self.fan(now, far + 1 - best[now])
            target = self.targets[edges]
            tight = (np.repeat(best[now], n) + self.weights[edges] == best[target]) & (depth[target] < 0)
            target, origin, edges = target[tight], np.repeat(now, n)[tight], edges[tight]
            first = np.lexsort((origin, target))
            target, origin, edges = target[first], origin[first], edges[first]
            fresh = np.concatenate([[True], target[1:] != target[:-1]]) if len(target) else np.zeros(0, bool)
            now, level = target[fresh], level + 1
            before[now], depth[now], by[now] = origin[fresh], level, edges[fresh]
        return best, before, depth, by


def network(edges: DataFrame) -> Network | None:
    """The graph of (from_id, to_id, weight) as arrays; None if it has more than ``MOST_SENT`` edges."""
    if edges.count() > MOST_SENT:
        return None
    rows = edges.select("from_id", "to_id", "weight").toArrow()
    a, b, w = (rows.column(n).to_numpy().astype(np.int64) for n in ("from_id", "to_id", "weight"))
    return Network.of(a, b, w)


def near_sources(edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges of the components that hold a source, node and component of these): searches from there never leave them."""
    found = contracted_components(edges.select("from_id", "to_id"), checkpoint=checkpointed)
    wanted = found.join(sources.select(F.col("source").alias("node")).distinct(), "node", "left_semi").select("component").distinct()
    nodes = checkpointed(found.join(wanted, "component", "left_semi").select("node", "component"))
    return checkpointed(edges.join(nodes.select(F.col("node").alias("from_id")), "from_id", "left_semi")), nodes


#: Tasks that searches are spread over, if there are enough sources.
SEARCHES = 64


def _in_parts(edges: DataFrame, sources: DataFrame, nodes: DataFrame, run: Callable, schema: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of ``run(network, sources)`` by component, edges and sources of components that are too large to search in a task).

    A component's edges go to as many tasks as share its sources, in front of
    them: a task holds one component's arrays, and its results flow on source
    by source.
    """
    placed = edges.join(nodes.select(F.col("node").alias("from_id"), F.col("component").alias("part")), "from_id")
    # sources that are no nodes of the graph have no component
    asked = checkpointed(sources.select("source").distinct().join(nodes.select(F.col("node").alias("source"), F.col("component").alias("part")), "source", "left"))
    sizes = checkpointed(placed.groupBy("part").agg(F.count(F.lit(1)).alias("edges")))
    parts, most = sizes.count(), F.col("edges") > MOST_SENT
    large = sizes.where(most).select("part")
    copies = max(1, -(-SEARCHES // max(1, parts)))
    small_edges = placed.join(large, "part", "left_anti").select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("copy"), F.lit(0).alias("kind"), F.col("from_id").alias("x"), F.col("to_id").alias("y"), F.col("weight").cast("long").alias("w"))
    small_sources = asked.join(large, "part", "left_anti").select("part", F.pmod(F.xxhash64("source"), F.lit(copies)).cast("long").alias("copy"), F.lit(1).alias("kind"), F.col("source").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("w"))

    def search(batches):
        now, held, graph = None, [], None
        for batch in batches:
            key = np.stack([batch.column(n).fill_null(-1).to_numpy() for n in ("part", "copy", "kind")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1 if key.shape[1] else np.zeros(0, int)
            for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), key.shape[1]], strict=True):
                if first == last:
                    continue
                x, y, w = (batch.column(n).to_numpy()[first:last].astype(np.int64) for n in ("x", "y", "w"))
                if (own := tuple(key[:2, first].tolist())) != now:
                    now, held, graph = own, [], None
                if key[2, first] == 0:
                    held.append((x, y, w))
                    continue
                if graph is None:
                    none = np.zeros(0, np.int64)
                    graph = Network.of(*[np.concatenate([none, *[h[n] for h in held]]) for n in range(3)])
                    held = []
                yield from run(graph, x)

    rows = small_edges.unionAll(small_sources)
    tasks = max(1, min(2_000, parts * copies))
    spread = rows.repartition(tasks, "part", "copy").sortWithinPartitions("part", "copy", "kind")
    found = spread.mapInArrow(search, schema)
    far = placed.join(large, "part", "left_semi").select("from_id", "to_id", "weight")
    return found, far, asked.join(large, "part", "left_semi").select("source")


def routes(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """req_id, metric, path (array of nodes) of (req_id, source, target); metric null and path empty if there is none.

    A graph that can be sent is searched in the tasks.  Of a larger one only the
    components of the sources are kept; if they are too large, rounds of joins
    find the metrics, and paths are walked backwards for all requests together.
    """
    edges = checkpointed(edges.select("from_id", "to_id", "weight"))
    sent = network(edges)
    if sent is None:
        edges, _ = near_sources(edges, requests)
        sent = network(edges)
    if sent is None:
        return _joined_routes(edges, requests)
    shared = edges.sparkSession.sparkContext.broadcast(sent)

    def run(batches):
        graph = shared.value
        for rows in batches:
            out = []
            for req, source, target in zip(rows["req_id"], rows["source"], rows["target"], strict=True):
                first, last = graph.place(int(source)), graph.place(int(target))
                metric, path = None, []
                if first >= 0 and last >= 0:
                    best, before, _ = graph.tree(first)
                    if best[last] >= 0:
                        metric, path = int(best[last]), [last]
                        while path[-1] != first:
                            path.append(int(before[path[-1]]))
                out.append((req, metric, [int(graph.nodes[n]) for n in reversed(path)]))
            yield pd.DataFrame(out, columns=["req_id", "metric", "path"]).astype({"metric": "Int64"})

    return requests.select("req_id", "source", "target").mapInPandas(run, "req_id long, metric long, path array<long>")


def _joined_routes(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """``routes`` without sending the graph."""
    # a link counts one besides its weight, so that of equal ways the one with the fewest links is least, as in ``tree``
    unit = 1 << 20
    links = checkpointed(edges.groupBy("from_id", "to_id").agg((F.min("weight") * unit + 1).alias("weight")))
    best = distances(links, requests.select("source").distinct())
    found = requests.select("req_id", "source", "target").join(best.withColumnRenamed("node", "target"), ["source", "target"], "left")
    ahead = best.join(links, best["node"] == links["from_id"]).select("source", F.col("node").alias("origin"), F.col("to_id").alias("node"), (F.col("metric") + F.col("weight")).alias("metric"))
    before = checkpointed(ahead.join(best, ["source", "node", "metric"]).groupBy("source", "node").agg(F.min("origin").alias("origin")))
    known = F.col("metric").isNotNull()
    paths = checkpointed(found.select("req_id", "source", F.when(known, F.col("target")).alias("at"), F.floor(F.col("metric") / unit).alias("metric"), F.when(known, F.array("target")).otherwise(F.array().cast("array<long>")).alias("path")))
    while not (walking := paths.where("at <> source")).isEmpty():
        back = walking.join(before.withColumnRenamed("node", "at"), ["source", "at"]).select("req_id", "source", F.col("origin").alias("at"), "metric", F.concat(F.array("origin"), "path").alias("path"))
        paths = checkpointed(back.unionByName(paths.where("at IS NULL OR at = source")))
    return paths.select("req_id", "metric", "path")


def many_distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """source, node, metric of every reachable node.

    A graph that can be sent is searched in the tasks, a larger one component by
    component, and a component that is too large by rounds of joins.
    """
    edges = checkpointed(edges.select("from_id", "to_id", "weight"))
    sent = network(edges)
    if sent is None:
        sources = checkpointed(sources.select("source").distinct())
        found, far, left = _in_parts(*_kept(edges, sources), _metrics_of, "source long, node long, metric long")
        return found if left.isEmpty() else found.unionAll(distances(far, left))
    shared = edges.sparkSession.sparkContext.broadcast(sent)

    def run(batches):
        graph = shared.value
        for rows in batches:
            for source in rows["source"]:
                at = graph.place(int(source))
                best = graph.metrics(at) if at >= 0 else np.zeros(0, np.int64)
                reached = np.flatnonzero(best >= 0)
                nodes, metrics = (graph.nodes[reached], best[reached]) if at >= 0 else ([int(source)], [0])
                yield pd.DataFrame({"source": int(source), "node": nodes, "metric": metrics})

    # a source is a search over the whole graph: each goes to a task of its own
    spread = sources.select("source").distinct().repartition(64, "source")
    return spread.mapInPandas(run, "source long, node long, metric long")


def _kept(edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    kept, nodes = near_sources(edges, sources)
    return kept, sources, nodes


def _metrics_of(graph: Network, sources: np.ndarray) -> Iterator[pa.RecordBatch]:
    for source in sources.tolist():
        at = graph.place(source)
        best = graph.metrics(at) if at >= 0 else np.zeros(0, np.int64)
        reached = np.flatnonzero(best >= 0)
        nodes, metrics = (graph.nodes[reached], best[reached]) if at >= 0 else (np.array([source]), np.zeros(1, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), source)), pa.array(nodes), pa.array(metrics)], names=["source", "node", "metric"])


def _visits_of(graph: Network, sources: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Visits of edges over the trees of some sources, added up on the graph's edges."""
    visits = np.zeros(len(graph.targets), np.int64)
    for source in sources.tolist():
        at = graph.place(source)
        if at < 0:
            continue
        _, before, depth, by = graph.edge_tree(at)
        total = tree_sums(before, depth)
        own = np.flatnonzero(by >= 0)
        # a node is reached by one edge, so no edge is there twice
        visits[by[own]] += total[own]
    used = np.flatnonzero(visits)
    origin = np.searchsorted(graph.starts, used, side="right") - 1
    yield pa.RecordBatch.from_arrays([pa.array(graph.nodes[origin]), pa.array(graph.nodes[graph.targets[used]]), pa.array(visits[used])], names=["from_id", "to_id", "visits"])


def tree_sums(before: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """How many nodes lie at or behind each node of a search tree, summed from the farthest level on."""
    sums = (depth >= 0).astype(np.int64)
    for level in range(int(depth.max(initial=0)), 0, -1):
        own = np.flatnonzero(depth == level)
        np.add.at(sums, before[own], sums[own])
    return sums


def traffic(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """from_id, to_id, visits: over how many shortest paths from sources to nodes an edge lies.

    Each search's tree is summed from its farthest nodes to its source.  A
    graph that can't be sent is searched component by component; one with a
    component that can't be sent is refused: cut it by country or cluster first.
    """
    schema = "from_id long, to_id long, visits long"
    edges = checkpointed(edges.select("from_id", "to_id", "weight"))
    sent = network(edges)
    if sent is None:
        sources = checkpointed(sources.select("source").distinct())
        found, _, left = _in_parts(*_kept(edges, sources), _visits_of, schema)
        if not left.isEmpty():
            raise ValueError(f"a component of more than {MOST_SENT} edges: traffic needs components that can be sent")
        return found.groupBy("from_id", "to_id").agg(F.sum("visits").alias("visits"))
    shared = edges.sparkSession.sparkContext.broadcast(sent)

    def run(batches):
        for batch in batches:
            yield from _visits_of(shared.value, batch.column("source").to_numpy())

    spread = sources.select("source").distinct().repartition(64, "source")
    return spread.mapInArrow(run, schema).groupBy("from_id", "to_id").agg(F.sum("visits").alias("visits"))


def modularity(links: DataFrame, clusters: DataFrame, gamma: float = 1.0) -> DataFrame:
    """cluster, inner, total, q: each cluster's share of the modularity of (a, b, weight)."""
    both = links.select("a", "b", "weight").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    ca, cb = clusters.select(F.col("node").alias("a"), F.col("cluster").alias("ca")), clusters.select(F.col("node").alias("b"), F.col("cluster").alias("cb"))
    by = both.join(ca, "a").join(cb, "b").groupBy(F.col("ca").alias("cluster")).agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("inner"), F.sum("weight").alias("total"))
    whole = by.agg(F.sum("total").alias("m2"))
    share = F.col("total") / F.col("m2")
    return by.join(F.broadcast(whole)).select("cluster", "inner", "total", (F.col("inner") / F.col("m2") - gamma * share * share).alias("q"))


def label_regions(edge_rows: DataFrame, nodes_share: DataFrame, small: int = 500, large: int = 10_000) -> DataFrame:
    """region, label of regions of unlabelled edges, from their size and what they touch.

    ``edge_rows``: edge, region, residential; ``nodes_share``: region that touches a restricted edge.
    """
    by = edge_rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("residential").cast("int")).alias("only"))
    joined = by.join(nodes_share.select("region", F.lit(True).alias("touches")).distinct(), "region", "left")
    label = F.when(F.col("touches").isNull(), "free").when((F.col("n") < small) & (F.col("only") == 1), "secondary").when(F.col("n") > large, "free").otherwise("secondary")
    return joined.select("region", "n", label.alias("label"))
