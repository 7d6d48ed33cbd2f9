"""Energy minimisation on a graph of labelled nodes: TRW-S and belief propagation.

After Kolmogorov, "Convergent Tree-Reweighted Message Passing for Energy Minimization"
(2006).  A model is one sequential problem, so models are the unit of parallel work.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Graph:
    """Nodes with costs by label, edges with cost matrices; built first, then solved."""

    costs: list[np.ndarray] = field(default_factory=list)
    edges: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def add_node(self, costs) -> int:
        self.costs.append(np.asarray(costs, float).copy())
        return len(self.costs) - 1

    def add_node_data(self, node: int, costs) -> None:
        self.costs[node] += costs

    def add_edge(self, i: int, j: int, matrix) -> None:
        matrix = np.asarray(matrix, float)
        if i == j or matrix.shape != (len(self.costs[i]), len(self.costs[j])):
            raise ValueError("an edge joins two nodes, with one cost for each pair of their labels")
        self.edges.append((i, j, matrix))

    def energy(self, labels) -> float:
        return float(sum(c[x] for c, x in zip(self.costs, labels, strict=True)) + sum(v[labels[i], labels[j]] for i, j, v in self.edges))


def automatic_order(nodes: int, edges) -> list[int]:
    """Grows a boundary: next comes the boundary node with the fewest neighbours left."""
    near = [set() for _ in range(nodes)]
    for i, j, _ in edges:
        near[i].add(j)
        near[j].add(i)
    left, done, order = [len(n) for n in near], [False] * nodes, []
    for start in sorted(range(nodes), key=lambda n: (len(near[n]), n)):
        heap = [(left[start], start)]
        while heap:
            degree, n = heapq.heappop(heap)
            if done[n]:
                continue
            if degree != left[n]:
                heapq.heappush(heap, (left[n], n))
                continue
            done[n] = True
            order.append(n)
            for m in near[n]:
                left[m] -= 1
                if not done[m]:
                    heapq.heappush(heap, (left[m], m))
    return order


@dataclass
class Result:
    labels: list[int]
    energy: float
    lower_bound: float | None
    iterations: int
    min_marginals: list[np.ndarray]


class _Messages:
    """All messages of a graph, stacked so that a node sends along all its edges at once.

    Label numbers are filled up to the largest: filling labels cost infinity and their
    messages are 0.  Edges stand sorted by their earlier node for sending forward, and in a
    second copy of the cost matrices by their later node for sending back.
    """

    def __init__(self, graph: Graph, order: list[int], method: str, seed: int | None, span: tuple[float, float]):
        n, most = len(graph.costs), max((len(c) for c in graph.costs), default=0)
        rank = np.empty(n, int)
        rank[order] = np.arange(n)
        self.costs, self.real = np.full((n, most), np.inf), np.zeros((n, most), bool)
        for i, c in enumerate(graph.costs):
            self.costs[i, : len(c)], self.real[i, : len(c)] = c, True
        self.full = bool(self.real.all())
        first, last, tables = np.zeros(len(graph.edges), int), np.zeros(len(graph.edges), int), np.zeros((len(graph.edges), most, most))
        for e, (i, j, v) in enumerate(graph.edges):
            if rank[i] > rank[j]:
                i, j, v = j, i, v.T
            first[e], last[e] = i, j
            tables[e, : v.shape[0], : v.shape[1]] = v
        by_first = np.lexsort((rank[last], rank[first]))
        self.first, self.last, self.ahead_cost = first[by_first], last[by_first], tables[by_first]
        #: Edges by their later node, as places among those by their earlier node.
        self.back = np.lexsort((rank[self.first], rank[self.last]))
        self.behind_cost = np.ascontiguousarray(self.ahead_cost[self.back].transpose(0, 2, 1))
        nodes = np.arange(n)
        self.ahead_at = np.searchsorted(rank[self.first], rank[nodes]), np.searchsorted(rank[self.first], rank[nodes], "right")
        behind = rank[self.last[self.back]]
        self.behind_at = np.searchsorted(behind, rank[nodes]), np.searchsorted(behind, rank[nodes], "right")
        rng = np.random.default_rng(seed) if seed is not None else None
        start = lambda to: np.where(self.real[to], rng.uniform(*span, (len(to), most)), 0.0) if rng is not None else np.zeros((len(to), most))
        self.forward, self.backward = start(self.last), start(self.first)  # into the later and the earlier node
        degree = np.maximum(self.ahead_at[1] - self.ahead_at[0], self.behind_at[1] - self.behind_at[0])
        self.share = np.ones(n) if method == "bp" else 1.0 / np.maximum(1, degree)

    def ahead(self, i: int) -> slice:
        return slice(self.ahead_at[0][i], self.ahead_at[1][i])

    def behind(self, i: int) -> np.ndarray:
        return self.back[self.behind_at[0][i] : self.behind_at[1][i]]

    def belief(self, i: int) -> np.ndarray:
        return self.costs[i] + self.backward[self.ahead(i)].sum(axis=0) + self.forward[self.behind(i)].sum(axis=0)

    def _sent(self, own: np.ndarray, tables: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, float]:
        """Messages, least 0, and what was taken off them."""
        out = (own[:, :, None] + tables).min(axis=1)
        if not self.full:
            out[~self.real[to]] = np.inf
        low = out.min(axis=1)
        out -= low[:, None]
        if not self.full:
            out[~self.real[to]] = 0.0
        return out, float(low.sum())

    def send_ahead(self, i: int, b: np.ndarray) -> None:
        at = self.ahead(i)
        if at.start < at.stop:
            self.forward[at], _ = self._sent(self.share[i] * b - self.backward[at], self.ahead_cost[at], self.last[at])

    def send_behind(self, i: int, b: np.ndarray) -> float:
        at = self.behind(i)
        if not len(at):
            return 0.0
        tables = self.behind_cost[self.behind_at[0][i] : self.behind_at[1][i]]
        self.backward[at], low = self._sent(self.share[i] * b - self.forward[at], tables, self.first[at])
        return low

    def labels(self, order: list[int]) -> list[int]:
        """Node after node the label that costs least given the labels before it."""
        out = np.zeros(len(self.costs), int)
        for i in order:
            at = self.behind(i)
            b = self.costs[i] + self.backward[self.ahead(i)].sum(axis=0) + self.ahead_cost[at, out[self.first[at]]].sum(axis=0)
            out[i] = int(np.argmin(b))
        return out.tolist()


def minimize(graph: Graph, method: str = "trws", iterations: int = 100, eps: float = -1.0, order: list[int] | None = None, seed: int | None = None, span: tuple[float, float] = (0.0, 1.0)) -> Result:
    """Forward and backward passes of messages; ``eps`` >= 0 stops once the bound gains no more.

    ``trws`` weighs a node by the longer of its chains and keeps a lower bound; ``bp`` does
    neither.  Messages start at 0 or, with a seed, at random.
    """
    order = automatic_order(len(graph.costs), graph.edges) if order is None else order
    sent = _Messages(graph, order, method, seed, span)
    bound, done, marginals = None, 0, [c.copy() for c in graph.costs]
    for done in range(1, iterations + 1):
        for i in order:
            b = sent.belief(i)
            sent.send_ahead(i, b - b.min())
        total = 0.0
        for i in reversed(order):
            b = sent.belief(i)
            marginals[i], low = b[sent.real[i]], b.min()
            total += low + sent.send_behind(i, b - low)
        stop = eps >= 0 and bound is not None and total - bound <= eps
        bound = total
        if stop:
            break
    labels = sent.labels(order)
    return Result(labels, graph.energy(labels), bound if method == "trws" else None, done, marginals)


def packed(pairwise: DataFrame) -> DataFrame:
    """Costs in long form (model_id, i, j, label1, label2, cost) as one row a pair, ``costs`` by label1, then label2."""
    cells = F.array_sort(F.collect_list(F.struct("label1", "label2", "cost")))
    return pairwise.groupBy("model_id", "i", "j").agg(F.transform(cells, lambda x: x["cost"]).alias("costs"))


def solve(unary: DataFrame, pairwise: DataFrame, method: str = "trws", iterations: int = 100) -> DataFrame:
    """unary: model_id, node, label, cost; pairwise: model_id, i, j, and costs, one for each pair of labels in order.

    Returns model_id, node, label, energy, lower_bound.  Labels are numbers of any kind; every
    node has the same ones.  Pairs in long form are packed first (``packed``).
    """

    def one(key, nodes, pairs):
        import pandas as pd

        labels, ids = np.sort(nodes.label.unique()), np.sort(nodes.node.unique())
        table = np.zeros((len(ids), len(labels)))
        table[np.searchsorted(ids, nodes.node), np.searchsorted(labels, nodes.label)] = nodes.cost
        graph = Graph(list(table))
        pairs = pairs.sort_values(["i", "j"])
        for i, j, v in zip(np.searchsorted(ids, pairs.i), np.searchsorted(ids, pairs.j), pairs.costs, strict=True):
            graph.add_edge(int(i), int(j), np.reshape(v, (len(labels), len(labels))))
        got = minimize(graph, method, iterations)
        return pd.DataFrame({"model_id": key[0], "node": ids, "label": labels[got.labels], "energy": got.energy, "lower_bound": got.lower_bound})

    kinds = dict(unary.dtypes)
    pairwise = pairwise if "costs" in pairwise.columns else packed(pairwise)
    # Both may come from one plan: columns of their own keep the two apart.
    pairwise = pairwise.select(*[F.col(c).alias(c) for c in ("model_id", "i", "j", "costs")])
    schema = f"model_id {kinds['model_id']}, node {kinds['node']}, label {kinds['label']}, energy double, lower_bound double"
    return unary.groupBy("model_id").cogroup(pairwise.groupBy("model_id")).applyInPandas(one, schema)
