"""Approximate nearest neighbours by learned partitions (operator 6).

Fitting uses a bounded sample of distinct vectors: their neighbour graph is cut
into parts of equal size by recursive spectral bisection and refined by moves
that cut fewer edges. A small softmax classifier then learns which parts the
neighbours of a vector lie in. Every row of the table is indexed under its most
probable part. A query goes to its most probable parts, as many as hold
``COVER`` of its probability, and is ranked against all rows there.

Parts are dealt in slices by a hash of the row's id, sized from counts, so that
a part of any size, and any number of copies of one vector, is spread over
tasks, and so are the queries that visit a part, in blocks by a hash of their
id. Each slice gives the best few per query of a block, and a last small ranking
joins them.

Defined results: vectors that are null, zero, of another length than the
commonest, or hold null or non-finite components take no part; null ids and
repeated rows: an id stands for its row, rows of the query's own id are not its
candidates, null ids take no part; a table with no usable rows gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from errata.llm.common import read_table, written

#: Distinct vectors (smallest hashes) the partition is fitted on, at most.
SAMPLE = 4096
NEIGHBOURS = 10
PARTS = 32
#: A query visits its most probable parts until they hold this probability.
COVER = 0.9
MIN_PARTS = 4
#: Rows and queries of a part in one task, about, and queries ranked there at a time.
SLICE_ROWS = 20_000
SLICE_QUERIES = 20_000
QUERY_BLOCK = 256
QUERY_STEP = 50
TOP = 5


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> list[np.ndarray]:
    """Symmetric neighbour lists of the unit rows of ``x``."""
    n = len(x)
    k = min(k, n - 1)
    near: list[set[int]] = [set() for _ in range(n)]
    for at in range(0, n, 512):
        s = x[at:at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        for i, row in enumerate(np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.empty((len(s), 0), int)):
            for j in row.tolist():
                near[at + i].add(j)
                near[j].add(at + i)
    return [np.array(sorted(v), dtype=int) for v in near]


def _bisect(nodes: np.ndarray, graph: list[np.ndarray], share: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Cut ``nodes`` along the second eigenvector of their graph's random walk."""
    at = np.full(len(graph), -1)
    at[nodes] = np.arange(len(nodes))
    pairs = [(i, j) for i, v in enumerate(nodes) for j in at[graph[v]] if j >= 0]
    a, b = np.array(pairs, dtype=int).reshape(-1, 2).T
    degree = np.bincount(a, minlength=len(nodes)) + 1e-9
    f = rng.standard_normal(len(nodes))
    for _ in range(60):
        f = 0.5 * (f + np.bincount(a, weights=f[b], minlength=len(nodes)) / degree)
        f -= (f * degree).sum() / degree.sum()
        f /= np.linalg.norm(f) + 1e-300
    order = nodes[np.argsort(f, kind="stable")]
    cut = round(len(nodes) * share)
    return order[:cut], order[cut:]


def partition_graph(graph: list[np.ndarray], parts: int, slack: float = 0.05, sweeps: int = 8) -> np.ndarray:
    """Part of each node: sizes differ by at most ``slack`` from equal ones."""
    rng = np.random.default_rng(7)
    label = np.zeros(len(graph), dtype=int)
    todo = [(np.arange(len(graph)), 0, parts)]
    while todo:
        nodes, first, count = todo.pop()
        if count == 1:
            label[nodes] = first
            continue
        left = count // 2
        one, two = _bisect(nodes, graph, left / count, rng)
        todo += [(one, first, left), (two, first + left, count - left)]
    size = np.bincount(label, minlength=parts)
    most = int(np.ceil(len(graph) / parts * (1 + slack)))
    least = int(len(graph) / parts * (1 - slack))
    for _ in range(sweeps):
        moved = 0
        for v in rng.permutation(len(graph)):
            if not len(graph[v]):
                continue
            links = np.bincount(label[graph[v]], minlength=parts)
            here = label[v]
            links[size >= most] = -1
            to = int(links.argmax())
            if links[to] > (label[graph[v]] == here).sum() and size[here] > least:
                label[v] = to
                size[here] -= 1
                size[to] += 1
                moved += 1
        if not moved:
            break
    return label


class Router:
    """Softmax over parts from a unit vector."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @property
    def parts(self) -> int:
        return self.weights.shape[1]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights[:-1] + self.weights[-1]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit_router(x: np.ndarray, parts: int = PARTS) -> Router:
    """Classifier for the parts that hold a vector and its neighbours."""
    dims = x.shape[1] if x.ndim == 2 else 0
    parts = max(1, min(parts, len(x) // 8))
    if parts == 1:
        return Router(np.zeros((dims + 1, 1)))
    graph = neighbour_graph(x)
    label = partition_graph(graph, parts)
    want = np.zeros((len(x), parts))
    for v, near in enumerate(graph):
        want[v] = np.bincount(label[near], minlength=parts) + np.bincount(label[[v]], minlength=parts)
    want /= want.sum(axis=1, keepdims=True)
    model = Router(np.zeros((dims + 1, parts)))
    w, prev = model.weights, model.weights
    ones = np.hstack([x, np.ones((len(x), 1))])
    for k in range(400):  # accelerated gradient; unit rows bound the curvature
        model.weights = w
        g = ones.T @ (model(x) - want) / len(x) + 1e-4 * w
        new = w - 2.0 * g
        w, prev = new + k / (k + 3) * (new - prev), new
    model.weights = prev
    return model


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, v): vectors of the commonest length, as doubles."""
    v = F.col("embedding").cast("array<double>")
    ok = ("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 "
          "AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < DOUBLE('Infinity')) AND exists(v, x -> x <> 0)")
    found = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(ok)
    common = (found.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n")
              .limit(1).collect())
    return found.where(F.size("v") == (common[0].n if common else 0))


def _unit(v: pd.Series) -> np.ndarray:
    x = np.array(v.tolist(), dtype=float)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sample_vectors(found: DataFrame, count: int = SAMPLE) -> np.ndarray:
    """Unit rows of up to ``count`` distinct vectors, by smallest hash: copies count once."""
    ids = found.groupBy(F.xxhash64("v").alias("h")).agg(F.min("vec_id").alias("vec_id")).orderBy("h").limit(count)
    rows = found.join(written(ids, "ann-sample"), "vec_id").dropDuplicates(["h"]).orderBy("h").select("v").collect()
    return _unit(pd.Series([r.v for r in rows])) if rows else np.zeros((0, 0))


def indexed(found: DataFrame, router: Router) -> DataFrame:
    """(vec_id, v, part) of every row: its most probable part."""
    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.assign(part=router(_unit(f["v"])).argmax(axis=1).astype("int32"))
    return found.mapInPandas(assign, "vec_id long, v array<double>, part int")


def routed(queries: DataFrame, router: Router, cover: float = COVER) -> DataFrame:
    """(query_id, q, part): a row for each part a query visits."""
    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            p = router(_unit(f["v"]))
            order = np.argsort(-p, axis=1, kind="stable")
            before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
            rank = np.arange(p.shape[1])
            row, at = np.nonzero((before < cover) | (rank < MIN_PARTS))
            yield pd.DataFrame({"query_id": f["vec_id"].to_numpy()[row], "q": f["v"].to_numpy()[row],
                                "part": order[row, at].astype("int32")})
    return queries.mapInPandas(choose, "query_id long, q array<double>, part int")


def _near_one(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that no square over- or underflows; no digit changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def _cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of ``q`` with every row; equal rows give equal numbers."""
    x, q = _near_one(x), _near_one(q)
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def rank_slice(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, top: int) -> list[tuple]:
    """(query_id, vec_id, score) of the ``top`` best rows of one slice for each query."""
    out = []
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for at in range(0, len(q), QUERY_BLOCK):
        block = q[at:at + QUERY_BLOCK]
        uq = block / np.abs(block).max(axis=1, keepdims=True)
        uq /= np.linalg.norm(uq, axis=1, keepdims=True)
        s = uq @ unit.T
        s[query_ids[at:at + QUERY_BLOCK, None] == ids[None, :]] = -np.inf
        for i, row in enumerate(s):
            # Product rounding decides nothing: all within it of the last place are ranked exactly.
            floor = np.partition(row, len(row) - top)[len(row) - top] if len(row) > top else -np.inf
            near = np.nonzero((row >= floor - 1e-12) & (row > -np.inf))[0]
            exact = _cosines(x[near], block[i])
            for k in np.lexsort((ids[near], -exact))[:top]:
                out.append((query_ids[at + i], ids[near[k]], exact[k]))
    return out


def search(index: DataFrame, visits: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): rows of the visited parts, nearest first."""
    def pieces(df: DataFrame, rows: int) -> Column:
        """In how many pieces of about ``rows`` rows each part is dealt; one count a part passes the driver."""
        counts = {r.part: -(-r.n // rows) for r in df.groupBy("part").agg(F.count("*").alias("n")).collect()}
        found = F.create_map(*[F.lit(x) for p, n in (counts or {-1: 0}).items() for x in (p, n)])
        return F.coalesce(found[F.col("part")], F.lit(0))

    visits = written(visits, "ann-visits")
    slices, blocks = pieces(index, SLICE_ROWS), pieces(visits, SLICE_QUERIES)
    # Every slice of rows meets every block of queries.
    each = lambda n, name: F.explode(F.when(n > 0, F.sequence(F.lit(1), n))).alias(name)
    rows = (index.select("*", F.pmod(F.xxhash64("vec_id", "v"), slices).cast("int").alias("slice"), each(blocks, "block")))
    asks = visits.select("*", (F.pmod(F.xxhash64("query_id"), blocks).cast("int") + 1).alias("block"), each(slices, "slice1"))
    asks = asks.withColumn("slice", F.col("slice1") - 1).drop("slice1")

    def ranked(key: tuple, x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(x) and len(q):
            found = rank_slice(x["vec_id"].to_numpy(), np.array(x["v"].tolist()), q["query_id"].to_numpy(),
                               np.array(q["q"].tolist()), top)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    best = (rows.groupBy("part", "slice", "block").cogroup(asks.groupBy("part", "slice", "block"))
            .applyInPandas(ranked, "query_id long, vec_id long, score double"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, query_step: int = QUERY_STEP, top: int = TOP, parts: int = PARTS,
            cover: float = COVER, sample: int = SAMPLE) -> DataFrame:
    """The ``top`` nearest rows found for each row whose id is divisible by ``query_step``."""
    found = usable(table)
    router = fit_router(sample_vectors(found, sample), parts)
    index = written(indexed(found, router), "ann-index")
    queries = found.where(F.col("vec_id") % query_step == 0).dropDuplicates(["vec_id"])
    return search(index, routed(queries, router, cover), top)


def op6_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"))
