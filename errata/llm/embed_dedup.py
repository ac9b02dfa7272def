r"""Embedding near-duplicates by NN-descent (operator 12).

Vectors link when their cosine is ``SIMILARITY`` or more. Links can be a great
many inside a group of near copies, so they are counted without being listed:

1. Equal vectors are one class with a number of copies.
2. Balls: in the order of sign bits of random projections near vectors stand
   near each other; a vector within half the linking angle of a recent leader
   joins the leader's ball. Angles obey the triangle inequality, so all members
   of a ball link with each other. A few passes in different orders, of
   leaders only, bring the balls of a dense group together.
3. NN-descent on the leaders: lists of the ``NEIGHBOURS`` nearest start from
   neighbours in such orders, and from further orders' neighbours that are near
   enough to matter. In each round every vector introduces the vectors
   on its list, and those that list it, to each other, and lists keep the
   nearest. A reverse list of any length is dealt in groups of bounded size.
   A list whose last entry could still matter is saturated and doubles.
4. Audit: a sample of leaders is compared with all, in blocks. While too few of
   their true edges were found, new orders and further rounds follow (``AUDITS``
   times at most).
5. Balls whose leaders are near are resolved by angles: all members link, none
   do, or the members on the edge are compared. Union-find over balls gives
   components.

``SAMPLE`` bounds the audit only; every vector is indexed and linked.

Defined results: vectors that are null, zero or hold null or non-finite
components link with nothing and are components of their own; vectors of
different lengths never link; a null ``vec_id`` is named by the smallest other
id of its component, if any, and is not kept; rows of equal id and equal vector
are copies of each other (each links with the other); an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from errata.llm.common import read_table, with_default, written
from errata.llm.components import components

SIMILARITY = 0.95
#: List length to start with, orders that fill the first lists, and neighbours taken from each.
NEIGHBOURS = 8
ORDERS = 6
BESIDE = 2
#: Further orders, of which only pairs that may matter enter the lists.
SWEEPS = 18
#: Groups of neighbours multiplied at a time.
STACK = 512
#: Passes that join balls, and recent leaders a vector is compared with.
PASSES = 6
RECENT = 8
#: Leaders in the audit (about, at most twice), and the share of their true edges to be found.
SAMPLE = 256
RECALL = 0.99
#: Rounds between audits, and audits at most.
ROUNDS = 2
AUDITS = 8
#: Angles within this of a bound are settled by exact tests.
MARGIN = 1e-6


def _dims(frame: pd.DataFrame, column: str = "u") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row places, matrix) for each length of vector in a frame."""
    sizes = frame[column].map(len).to_numpy()
    for d in np.unique(sizes):
        at = np.nonzero(sizes == d)[0]
        yield at, np.stack(frame[column].to_numpy()[at]).astype(np.float64)


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def dot(a: str, b: str) -> Column:
    """Column: the product of two columns of equally long unit vectors."""
    @F.pandas_udf("double")
    def product(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        for at, m in _dims(pd.DataFrame({"u": x})):
            other = np.stack(y.to_numpy()[at]).astype(np.float64)
            out[at] = (m * other).sum(axis=1)
        return pd.Series(out)
    return product(F.col(a), F.col(b))


#: Vectors ``v`` that take part.
USABLE = ("v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < DOUBLE('Infinity')) "
          "AND exists(v, x -> x <> 0)")


def unit_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, h1, h2, u) of the vectors that take part; ``h1, h2`` name a vector."""
    found = table.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(USABLE)

    @F.pandas_udf("array<double>")
    def unit(values: pd.Series) -> pd.Series:
        out = np.empty(len(values), dtype=object)
        for at, x in _dims(pd.DataFrame({"u": values})):
            x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            out[at] = list(x)
        return pd.Series(out)

    keys = found.select("vec_id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"), "v")
    return keys.select("vec_id", "h1", "h2", unit("v").alias("u"))


def signature(column: str, seed: Column | int) -> Column:
    """Column: 63 sign bits of a vector's random projections, most telling first; ``seed`` picks them."""
    @F.pandas_udf("long")
    def bits(vectors: pd.Series, seeds: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors), dtype=np.int64)
        for at, x in _dims(pd.DataFrame({"u": vectors})):
            kinds = seeds.to_numpy()[at]
            for s in np.unique(kinds):
                here = kinds == s
                planes = np.random.default_rng([int(s), x.shape[1]]).standard_normal((x.shape[1], 63))
                out[at[here]] = ((x[here] @ planes) > 0) @ (1 << np.arange(62, -1, -1, dtype=np.int64))
        return pd.Series(out)
    return bits(F.col(column), F.lit(seed) if isinstance(seed, int) else seed)


def balls(points: DataFrame, similarity: float) -> DataFrame:
    """(node, center): every vector of ``points(node, u)`` within half the linking angle of its center."""
    reach = float(np.cos(np.arccos(similarity) / 2 - MARGIN))

    def lead(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaders: list[tuple[int, np.ndarray]] = []
        for f in frames:
            to = []
            for node, u in zip(f["node"].tolist(), f["u"]):
                near = None
                if leaders and len(leaders[-1][1]) == len(u):
                    same = [(n, x) for n, x in leaders if len(x) == len(u)]
                    products = np.array([x for _, x in same]) @ u
                    best = int(products.argmax())
                    if products[best] >= reach:
                        near = same[best][0]
                if near is None:
                    leaders = [*leaders[-RECENT + 1:], (node, u)]
                    near = node
                to.append(near)
            yield pd.DataFrame({"node": f["node"], "center": to})

    of = points.select("node", F.col("node").alias("center"))
    for k in range(PASSES):
        heads = points if k == 0 else points.join(of.select(F.col("center").alias("node")).distinct(), "node", "left_semi")
        placed = heads.select("node", "u", F.size("u").alias("dims"), signature("u", 100 + k).alias("sig"))
        placed = placed.repartitionByRange("dims", "sig", "node").sortWithinPartitions("dims", "sig", "node")
        moved = placed.select("node", "u").mapInPandas(lead, "node long, center long").where("node <> center")
        moved = written(moved.select(F.col("node").alias("center"), F.col("center").alias("next")), "balls-moved")
        if k == 0:  # every member is its own center, and was just compared
            of = of.join(moved, "center", "left").select("node", F.coalesce("next", "center").alias("center"))
        else:  # a member follows its center only if it is near the new one itself
            met = of.join(moved, "center").join(points, "node").join(points.select(F.col("node").alias("next"), F.col("u").alias("w")), "next")
            went = written(met.where(dot("u", "w") >= reach).select("node", "next"), "balls-went")
            of = of.join(went, "node", "left").select("node", F.coalesce("next", "center").alias("center"))
        of = written(of, "balls")
    return of


def beside(points: DataFrame, seeds: range, least: float = -2.0) -> DataFrame:
    """(a, b, s), both ways: neighbours in the orders of ``seeds`` with products
    of ``least`` or more, all orders in one shuffle."""
    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail: list[tuple] = []
        for f in frames:
            a, b, s = [], [], []
            for row in zip(f["seed"].tolist(), f["node"].tolist(), f["u"]):
                for order, node, u in tail:
                    if order == row[0] and len(u) == len(row[2]):
                        product = float(u @ row[2])
                        if product >= least:
                            a.append(node)
                            b.append(row[1])
                            s.append(product)
                tail = [*tail[-BESIDE + 1:], row]
            yield pd.DataFrame({"a": a + b, "b": b + a, "s": s + s}).astype({"a": "int64", "b": "int64", "s": "float64"})

    each = points.select("node", F.col("u").cast("array<float>").alias("u"), F.explode(F.array(*[F.lit(k) for k in seeds])).alias("seed"))
    placed = each.select("seed", F.size("u").alias("dims"), signature("u", F.col("seed")).alias("sig"), "node", "u")
    placed = placed.repartitionByRange("seed", "dims", "sig", "node").sortWithinPartitions("seed", "dims", "sig", "node")
    return placed.select("seed", "node", "u").mapInPandas(pairs, "a long, b long, s double")


def nearest_lists(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b, s, fresh) of the nearest of each ``a``: as many as its list holds."""
    each = edges.groupBy("a", "b").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh")).join(sizes, "a")
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("s"), "b"))
    return each.withColumn("rank", rank).where("rank <= k").select("a", "b", "s", "fresh")


def introduced(points: DataFrame, lists: DataFrame, sizes: DataFrame, turn: int) -> DataFrame:
    """(a, b, s), both ways: neighbours of one vector that have not met and are near enough for a list.

    Each vector's list and the vectors that list it meet in groups: the reverse
    list is dealt in groups of about ``2 * NEIGHBOURS``, the list joins each.
    """
    group = 2 * NEIGHBOURS
    bounds = (lists.groupBy("a").agg(F.count("*").alias("n"), F.min("s").alias("least")).join(sizes, "a")
              .select(F.col("a").alias("m"), F.when(F.col("n") >= F.col("k"), F.col("least")).otherwise(-2.0).alias("bound")))
    parts = lists.groupBy("b").agg(F.ceil(F.count("*") / group).cast("int").alias("parts"))
    back = lists.join(parts, "b").select(F.col("b").alias("hub"), F.col("a").alias("m"), "fresh",
                                         F.pmod(F.xxhash64("a", F.lit(turn)), F.col("parts")).cast("int").alias("part"))
    ahead = lists.join(parts.withColumnRenamed("b", "hub"), lists["a"] == F.col("hub"), "left").select(
        lists["a"].alias("hub"), lists["b"].alias("m"), "fresh",
        F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    members = ahead.unionByName(back).groupBy("hub", "part", "m").agg(F.max("fresh").alias("fresh"))
    met = members.join(points.select(F.col("node").alias("m"), F.col("u").cast("array<float>").alias("u")), "m").join(bounds, "m")
    groups = met.groupBy("hub", "part").agg(F.collect_list(F.struct("m", "fresh", "bound", "u")).alias("g")).where(
        "exists(g, x -> x.fresh) AND size(g) > 1")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(0)
            offsets = listed.offsets.to_numpy()
            starts, counts = offsets[:-1] - offsets[0], np.diff(offsets)
            m, fresh, bound, u = listed.flatten().flatten()
            dims = pc.list_value_length(u).to_numpy()
            places = np.concatenate([[0], np.cumsum(dims)])
            m, bound, values = m.to_numpy(), bound.to_numpy(), u.flatten().to_numpy()
            fresh = fresh.to_numpy(zero_copy_only=False)
            kinds = np.stack([counts, dims[starts]], axis=1)  # lengths differ between groups, never inside one
            for size, d in np.unique(kinds, axis=0).tolist():
                rows = starts[(kinds == (size, d)).all(axis=1)][:, None] + np.arange(size)
                for k in range(0, len(rows), STACK):
                    r = rows[k:k + STACK]
                    x = values[places[r][:, :, None] + np.arange(d)]
                    i, j, s = worthy(x.astype(np.float64), fresh[r], bound[r])
                    one, two = m[r][i], m[r][j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in ((one, two), (two, one), (s, s))],
                                                     names=["a", "b", "s"])

    return groups.select("g").mapInArrow(meet, "a long, b long, s double")


def worthy(x: np.ndarray, fresh: np.ndarray, bound: np.ndarray) -> tuple:
    """(places, places, products) of the pairs within each group ``x[g]`` that are worth a place on a list."""
    s = x @ x.transpose(0, 2, 1)
    new = fresh[:, :, None] | fresh[:, None, :]
    near = (s > bound[:, :, None]) | (s > bound[:, None, :])
    g, i, j = np.nonzero(np.triu(np.ones(s.shape[1:], dtype=bool), 1) & new & near)
    return (g, i), (g, j), s[g, i, j]


def near_leaders(points: DataFrame, similarity: float) -> DataFrame:
    """(a, b, s), a < b: pairs of leaders whose balls may link.

    ``points`` (node, u, radius). A pair matters if its angle is at most the
    linking angle and both radii.
    """
    theta = float(np.arccos(similarity))
    count = points.count()
    sizes = points.select(F.col("node").alias("a"), F.lit(NEIGHBOURS).alias("k"))
    radius = points.select(F.col("node").alias("b"), F.col("radius").alias("rb"))
    own = points.select(F.col("node").alias("a"), F.col("radius").alias("ra"))
    matters = f"acos(least(1D, s)) <= {theta + 2 * MARGIN} + ra + rb"
    floor = float(np.cos(min(2 * theta, np.pi))) - 1e-3  # below it not even two balls of the largest radius link
    first = beside(points, range(ORDERS)).union(beside(points, range(ORDERS, ORDERS + SWEEPS), floor))
    lists = written(nearest_lists(first.withColumn("fresh", F.lit(True)), sizes), "descent-lists")
    sampled = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(max(1, min(1, SAMPLE / max(1, count)) * (1 << 20)))
    asked = points.where(sampled).select("node", "u", "radius").collect()
    truth = written(true_edges(points, asked, theta), "descent-truth")
    turn = 0
    for audit in range(AUDITS):
        for _ in range(ROUNDS):
            found = introduced(points, lists, sizes, turn).withColumn("fresh", F.lit(True))
            lists = written(nearest_lists(lists.withColumn("fresh", F.lit(False)).unionByName(found), sizes), "descent-lists")
            turn += 1
        # The last entry of a full list still near enough for a ball of the largest radius: there may be more.
        full = lists.groupBy("a").agg(F.count("*").alias("n"), F.min("s").alias("least")).join(sizes, "a").join(own, "a")
        full = full.where(f"n >= k AND acos(least(1D, least)) <= {1.5 * theta + 2 * MARGIN} + ra")
        grown = written(full.select("a", (F.col("k") * 2).alias("k2")), "descent-saturated")
        saturated = not grown.isEmpty()
        if saturated:
            sizes = written(sizes.join(grown, "a", "left").select("a", F.coalesce("k2", "k").alias("k")), "descent-sizes")
        either = lists.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        missed = truth.join(either, ["a", "b"], "left_anti").count()
        enough = missed <= (1 - RECALL) * truth.count()
        if enough and not saturated:
            break
        if saturated:  # the longer lists are filled by the vectors around them, which have met before
            around = grown.select("a", F.lit(True).alias("more")).union(
                lists.join(grown.select("a"), "a").select(F.col("b").alias("a"), F.lit(True).alias("more"))).distinct()
            lists = lists.join(around, "a", "left").select("a", "b", "s", (F.col("fresh") | F.coalesce("more", F.lit(False))).alias("fresh"))
        if not enough:
            seeds = range(ORDERS + (audit + 1) * SWEEPS, ORDERS + (audit + 2) * SWEEPS)
            lists = lists.unionByName(beside(points, seeds, floor).withColumn("fresh", F.lit(True)))
        lists = written(nearest_lists(lists, sizes), "descent-lists")
    pairs = (lists.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s").union(truth.select("a", "b", "s"))
             .groupBy("a", "b").agg(F.max("s").alias("s")))
    near = pairs.join(own, "a").join(radius, "b").where(matters)
    return written(near.select("a", "b"), "descent-near")


def true_edges(points: DataFrame, asked: list, theta: float) -> DataFrame:
    """(a, b, s), a < b: all pairs that matter of the leaders ``asked``, by comparison with every leader."""
    queries: dict[int, list] = {}
    for r in asked:
        queries.setdefault(len(r.u), []).append(r)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at, x in _dims(f):
                rows = queries.get(x.shape[1], [])
                if not rows:
                    continue
                ids, q = np.array([r.node for r in rows]), np.array([r.u for r in rows])
                node, rad = f["node"].to_numpy()[at], f["radius"].to_numpy()[at]
                s = x @ q.T
                limit = theta + 2 * MARGIN + rad[:, None] + np.array([r.radius for r in rows])[None, :]
                i, j = np.nonzero((angle(s) <= limit) & (node[:, None] != ids[None, :]))
                yield pd.DataFrame({"a": np.minimum(node[i], ids[j]), "b": np.maximum(node[i], ids[j]), "s": s[i, j]})

    found = points.select("node", "u", "radius").mapInPandas(compare, "a long, b long, s double")
    return found.groupBy("a", "b").agg(F.max("s").alias("s"))


def resolved(points: DataFrame, members: DataFrame, near: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """((node, n) links beyond the own ball, (a, b) linked balls).

    ``points`` (node, u, radius, weight) are leaders, ``members`` (node, u,
    center, copies). A member whose angle to another leader is at most the
    linking angle less that ball's radius links with the whole ball; beyond the
    sum it links with none of it; between, it is compared with the other ball's
    members that are between as well.
    """
    theta = float(np.arccos(similarity))
    both = near.union(near.select("b", "a"))
    other = points.select(F.col("node").alias("b"), F.col("u").alias("w"), "radius", "weight")
    seen = (members.withColumnRenamed("center", "a").join(both, "a").join(other, "b")
            .select("node", "u", "copies", "a", "b", "radius", "weight", dot("u", "w").alias("s")))
    at = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("s"))))
    kind = (F.when(at + F.col("radius") <= theta - MARGIN, 2).when(at - F.col("radius") > theta + MARGIN, 0).otherwise(1))
    seen = written(seen.select("node", "u", "copies", "a", "b", "weight", kind.alias("kind")), "resolve-seen")
    whole = seen.where("kind = 2")
    edge = seen.where("kind = 1")
    # Members of the other ball that link with all of this one count for its members between, too.
    shared = whole.groupBy(F.col("b").alias("a"), F.col("a").alias("b")).agg(F.sum("copies").alias("n"))
    by_share = edge.join(shared, ["a", "b"]).select("node", "a", "b", "n")
    there = edge.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("u").alias("w"), F.col("copies").alias("n"))
    tested = edge.join(there, ["a", "b"]).where(dot("u", "w") >= similarity).select("node", "a", "b", "n")
    counts = written(whole.select("node", "a", "b", F.col("weight").alias("n")).union(by_share).union(tested)
                     .groupBy("node", "a", "b").agg(F.sum("n").alias("n")), "resolve-counts")
    return (counts.groupBy("node").agg(F.sum("n").alias("n")),
            counts.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def near_duplicates(table: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``table``."""
    full = with_default(with_default(table, "vec_id", "long"), "embedding", "array<double>").select("vec_id", "embedding")
    used = unit_vectors(full)
    classes = used.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("u").alias("u"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    of = balls(classes.select("node", "u"), similarity)
    members = written(classes.select("node", "u", "copies", "least").join(of, "node"), "ball-members")
    center = classes.select(F.col("node").alias("center"), F.col("u").alias("w"))
    far = F.acos(F.least(F.lit(1.0), F.min("s")))
    sized = (members.join(center, "center").select("center", "copies", dot("u", "w").alias("s"), "node")
             .select("center", "copies", F.when(F.col("node") == F.col("center"), 1.0).otherwise(F.col("s")).alias("s"))
             .groupBy("center").agg(far.alias("radius"), F.sum("copies").alias("weight")))
    points = written(sized.join(center, "center").select(F.col("center").alias("node"), F.col("w").alias("u"), "radius", "weight"), "ball-points")
    near = near_leaders(points, similarity)
    beyond, links = resolved(points, members.drop("least"), near, similarity)
    roots = components(links)
    weights = points.select(F.col("node").alias("center"), "weight")
    each = (members.select("node", "center", "least").join(weights, "center")
            .join(beyond, "node", "left").join(roots.withColumnRenamed("node", "center"), "center", "left")
            .select("node", "least", F.coalesce("root", "center").alias("root"),
                    (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    each = written(each, "vector-links")
    named = each.groupBy("root").agg(F.min("least").alias("component_id"))
    table_of = written(each.join(named, "root").join(classes.select("node", "h1", "h2"), "node").select("h1", "h2", "n_links", "component_id"),
                       "vector-components")
    rows = full.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    # Hashes skip nulls, so those of vectors that take no part name nothing.
    rows = rows.select("vec_id", *[F.when(F.expr(USABLE), h).alias(n) for n, h in (("h1", F.xxhash64("v")), ("h2", F.xxhash64(F.lit(7), "v")))])
    out = rows.join(table_of, ["h1", "h2"], "left")
    name = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), name.alias("component_id"),
                      F.coalesce(F.col("vec_id") == name, F.lit(False)).alias("kept"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE_SQL = f"""
WITH RECURSIVE e AS (SELECT row_number() OVER () AS i, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.i AS a, b.i AS b FROM ok a JOIN ok b ON a.i <> b.i AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {SIMILARITY}),
r AS (SELECT i, i AS j FROM e UNION SELECT r.i, l.b FROM r JOIN l ON l.a = r.j),
c AS (SELECT r.i, min(e.vec_id) AS component_id FROM r JOIN e ON e.i = r.j GROUP BY r.i)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM e JOIN c USING (i) LEFT JOIN (SELECT a AS i, count(*) AS n FROM l GROUP BY a) USING (i)
"""
