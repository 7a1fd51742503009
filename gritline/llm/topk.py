"""Exact top-k inner products by a dual-tree search over cover trees."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAF = 256
FAN = 8
QUERY_ROWS = 4096
TILE_ROWS = 2048
EXACT = 1 << 53


@dataclass
class Node:
    """Rows ``start:end`` of a tree's order, all within ``radius`` of the point ``center``."""

    start: int
    end: int
    center: np.ndarray
    norm: float
    radius: float
    children: list[Node] = field(default_factory=list)


def build(points: np.ndarray) -> tuple[np.ndarray, Node]:
    """Order of the rows, and the root of a cover tree over them.

    Each level covers a node's points by balls of half its radius around points that are farther
    than that from each other, the node's own center among them; they are found farthest first.
    A node has ``FAN`` children at most, with the radius that they then need, and nodes of up to
    ``LEAF`` points are leaves.
    """
    order: list[np.ndarray] = []
    placed = 0

    def grow(rows: np.ndarray, center: np.ndarray) -> Node:
        nonlocal placed
        far = np.sqrt(((points[rows] - center) ** 2).sum(axis=1))
        radius = float(far.max(initial=0.0))
        node = Node(placed, placed + len(rows), center, float(np.sqrt(center @ center)), radius)
        if len(rows) <= LEAF or radius == 0:
            order.append(rows)
            placed += len(rows)
            return node
        nearest, owner, centers = far, np.zeros(len(rows), np.int64), [center]
        while nearest.max() > radius / 2 and len(centers) < FAN:
            centers.append(points[rows[np.argmax(nearest)]])
            to_new = np.sqrt(((points[rows] - centers[-1]) ** 2).sum(axis=1))
            owner[to_new < nearest] = len(centers) - 1
            nearest = np.minimum(nearest, to_new)
        node.children = [grow(rows[owner == k], c) for k, c in enumerate(centers) if (owner == k).any()]
        return node

    rows = np.arange(len(points))
    middle = points.mean(axis=0)
    root = grow(rows, points[np.argmin(((points - middle) ** 2).sum(axis=1))])
    return np.concatenate(order), root


@dataclass
class Best:
    """The best scores of each query so far, in order; ids break ties."""

    scores: np.ndarray
    ids: np.ndarray

    def offer(self, start: int, end: int, scores: np.ndarray, ids: np.ndarray) -> None:
        worst = self.scores[start:end, -1:]
        use = np.flatnonzero((scores >= worst).any(axis=0))
        if not len(use):
            return
        k = self.scores.shape[1]
        all_scores = np.concatenate([self.scores[start:end], scores[:, use]], axis=1)
        all_ids = np.concatenate([self.ids[start:end], np.broadcast_to(ids[use], (end - start, len(use)))], axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=-1)[:, :k]
        self.scores[start:end] = np.take_along_axis(all_scores, order, axis=1)
        self.ids[start:end] = np.take_along_axis(all_ids, order, axis=1)


def dual_search(
    queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the best ``k`` rows of each query but itself; missing ones are -inf.

    The inner product of two points is at most that of the centers, plus each radius times the
    norm of the other center, plus both radii. A pair of nodes is left out if that is below the
    worst k-th score among the node's queries; equal scores are looked at, because of the ids.
    """
    q_order, q_root = build(queries)
    r_order, r_root = build(rows)
    q, qi, r, ri = queries[q_order], query_ids[q_order], rows[r_order], row_ids[r_order]
    best = Best(np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max))

    def bound(a: Node, b: Node) -> float:
        top = a.center @ b.center + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
        return float(top) + 1e-9 * (abs(float(top)) + 1)

    def visit(a: Node, b: Node, most: float) -> None:
        if most < best.scores[a.start : a.end, -1].min():
            return
        if not a.children and not b.children:
            scores = q[a.start : a.end] @ r[b.start : b.end].T
            own = qi[a.start : a.end, None] == ri[None, b.start : b.end]
            best.offer(a.start, a.end, np.where(own, -np.inf, scores), ri[b.start : b.end])
            return
        # Open the larger ball, so that the bound falls.
        if a.children and (not b.children or a.radius >= b.radius):
            pairs = [(x, b) for x in a.children]
        else:
            pairs = [(a, y) for y in b.children]
        ranked = sorted(((bound(x, y), n) for n, (x, y) in enumerate(pairs)), reverse=True)
        for limit, n in ranked:
            visit(*pairs[n], limit)

    visit(q_root, r_root, bound(q_root, r_root))
    scores, ids = np.empty_like(best.scores), np.empty_like(best.ids)
    scores[q_order], ids[q_order] = best.scores, best.ids
    return scores, ids


def plain_search(
    queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int
) -> list[tuple[int, int, int]]:
    """(query, row, score) of the best ``k`` rows, in whole numbers of any size, for tiles whose
    products floats can't hold. Scores are cut to the limits of a long before they are ranked."""
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    out = []
    for query, own in zip(queries.tolist(), query_ids.tolist()):
        scored = ((min(max(sum(a * b for a, b in zip(query, row)), low), high), i) for row, i in zip(rows.tolist(), row_ids.tolist()))
        ranked = sorted((-s, i) for s, i in scored if i != own)[:k]
        out += [(own, i, -s) for s, i in ranked]
    return out


def _distinct(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order]
    keep = np.append(True, ids[1:] != ids[:-1]) if len(ids) else np.zeros(0, bool)
    return ids[keep], vectors[keep]


def search_tile(table: pa.Table, k: int) -> pa.Table:
    ids = table["id"].to_numpy()
    dim = table["dim"][0].as_py()
    vectors = table["vec"].combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
    is_query = table["is_query"].to_numpy()
    qi, q = _distinct(ids[is_query], vectors[is_query])
    ri, r = ids[~is_query], vectors[~is_query]
    out_q, out_i, out_s = [], [], []
    if len(qi) and len(ri):
        largest = [max(map(abs, (int(x.max(initial=0)), int(x.min(initial=0))))) for x in (q, r)]
        if dim * largest[0] * largest[1] < EXACT and dim * max(largest) ** 2 < EXACT:
            scores, found = dual_search(q.astype(float), qi, r.astype(float), ri, k)
            row, col = np.nonzero(np.isfinite(scores))
            out_q, out_i, out_s = qi[row], found[row, col], scores[row, col].astype(np.int64)
        else:
            found = plain_search(q, qi, r, ri, k)
            out_q, out_i, out_s = zip(*found) if found else ([], [], [])
    columns = [pa.array(np.asarray(x, np.int64)) for x in (out_q, out_i, out_s)]
    return pa.table(columns, names=["query_id", "vec_id", "score"])


def top_k(
    df: DataFrame, k: int, every: int = 20, scale: float = 64.0,
    id_col: str = "vec_id", vector_col: str = "embedding", query_rows: int = QUERY_ROWS, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the best ``k`` rows of each query, itself left out.

    Queries are the rows whose id is divisible by ``every``. Components become floor(scale * x), the
    score is the inner product, and ties go to the smaller id. Vectors that are null or hold null
    or non-finite components, and rows with a null id, take no part. Of rows that repeat the id of a
    query, the one with the smallest vector asks; all rows of other ids are candidates, repeated ones too. Only vectors of equal length are compared. Scores
    beyond 64 bits are cut to the limits of a long before they are ranked; components are, too.

    Queries and rows are dealt into tiles of bounded size by a hash of the id, so equal vectors
    spread. Each pair of a query tile and a row tile is one dual-tree search; all pairs are
    searched, and a query's best of each row tile meet in a ranking.
    """
    vec = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    valid = F.col(vector_col).isNotNull() & F.forall(
        F.col(vector_col), lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x)
    )
    rows = df.where(valid & F.col(id_col).isNotNull() & (F.size(vector_col) > 0)).select(
        F.col(id_col).cast("bigint").alias("id"), vec.alias("vec"), F.size(vector_col).alias("dim")
    )
    sizes = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    tiles, query_tiles = max(1, -(-sizes[0] // tile_rows)), max(1, -(-sizes[1] // query_rows))
    own = F.pmod(F.xxhash64("id"), F.lit(tiles))
    group = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_tiles))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    candidates = rows.select("*", F.lit(False).alias("is_query"), own.alias("t"), all_of(query_tiles).alias("g"))
    queries = rows.where(F.col("id") % every == 0).select(
        "*", F.lit(True).alias("is_query"), all_of(tiles).alias("t"), group.alias("g")
    )
    found = (
        candidates.unionByName(queries)
        .groupBy("t", "g", "dim")
        .applyInArrow(lambda table: search_tile(table, k), "query_id bigint, vec_id bigint, score bigint")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
