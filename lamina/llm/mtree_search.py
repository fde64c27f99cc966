"""Exact top-k inner product search in an M-tree.

Inner products become a metric by one more component: a stored vector x gets
sqrt(M - |x|**2), M the largest |x|**2, and a query gets 0. Then the squared
distance of query and stored vector is |q|**2 + M - 2 q.x, and nearest means
largest inner product.

The tree has paged nodes: a root of pages, pages of leaf nodes, leaf nodes of
vectors. Each page and leaf node has a pivot and a covering radius, each leaf
node and vector the distance to its parent's pivot. A search takes nodes best
first from a queue by their least possible distance, and ends when that exceeds
the k-th best found. |d(q, parent) - stored distance| - radius bounds a node
before its own distance is computed, and skips that computation; the same bound
without radius skips vectors. Every vector is in one leaf; nothing is approximate.

Bounds allow for rounding: a squared distance is off by some 2 width + 16 units of
the last place of (|q| + sqrt(M))**2 at most, and the root of that, for each of the
distances of a bound, is its slack. Components are whole doubles; distances are
taken after division by a power of two that keeps squares finite. Scores are exact:
double products where |q| |x| is below 2**53, else integers of any length for those
that the doubles' error leaves in question.

Equal vectors are one entry with its k + 1 smallest ids, all that any query can
use. A query first searches the pages of its own cell. The k-th best score found
there is a bound that goes with it to the others, and a page is sent only to
blocks of queries (of one cell each) that may find better in it.

Defined cases: vectors that are null or hold null, NaN or infinite components
take no part, as query or candidate; null vec_id: no part. Finite components take
part however large; 256-fold ones beyond the largest double count as that. Scores
beyond a long's range are given as its least or greatest value, but ranked as they
are. Vectors of unlike length are compared as if zeros followed. Rows that repeat a
vec_id are candidates of their own; a query skips one row, itself. Empty table:
empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import io
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import constants, saved

#: Pivots of cells at least and at most: a sample of vectors; every vector is then stored under the nearest.
PIVOTS, MOST_PIVOTS = 256, 4096
#: Vectors of a page and of a leaf node, about; pages of a group of cells, which queries are sent to.
PAGE, LEAF, PAGES_AT_ONCE = 2048, 256, 64
#: Queries of a block at least and at most.
FEWEST_QUERIES, MOST_QUERIES = 64, 16384
EXACT = 2.0**53


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, vec: floor(scale * x) of each component as double, for vectors that take part."""
    most = F.lit(float(np.finfo(np.float64).max))

    def floored(x: Column) -> Column:
        y = F.greatest(-most, F.least(most, x * scale))
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double") + 0.0).otherwise(y)  # larger doubles are whole

    whole = F.transform("embedding", lambda x: x.cast("double"))
    usable = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        embeddings.select("vec_id", "embedding")
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .where(F.coalesce(usable, F.lit(False)))
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(whole, floored).alias("vec"))
    )


def matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, v in enumerate(vectors):
        out[row, : len(v)] = v
    return out


class Space:
    """Where distances are taken: vectors times 2**power (0 or less), and M, the largest square of a stored one's norm, of these."""

    def __init__(self, width: int, power: int, largest: float):
        self.width, self.power, self.largest = width, power, largest

    def points(self, vectors: np.ndarray) -> np.ndarray:
        """Stored vectors with the component that makes nearest mean largest inner product."""
        points = np.ldexp(vectors, self.power)
        rest = np.maximum(0.0, self.largest - (points * points).sum(axis=1))
        return np.hstack([points, np.sqrt(rest)[:, None]])

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        return np.hstack([np.ldexp(vectors, self.power), np.zeros((len(vectors), 1))])

    def scaled(self, score: int) -> float:
        """A score as an inner product of this space."""
        return score / (1 << (-2 * self.power))

    def slack(self, norms: np.ndarray) -> np.ndarray:
        """How far a bound on distances to queries of these norms may be off."""
        return 4 * np.sqrt((2 * self.width + 16) * 2.0**-52) * (norms + math.sqrt(self.largest))


def exact_score(a: np.ndarray, b: np.ndarray) -> int:
    return sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


def order_key(score: int) -> bytes:
    """Bytes that sort as the numbers do."""
    size = (abs(score).bit_length() + 7) // 8
    key = size.to_bytes(2, "big") + abs(score).to_bytes(size, "big")
    return b"\1" + key if score >= 0 else b"\0" + bytes(255 - x for x in key)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, square))


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(blob), allow_pickle=False))


def build_page(vectors: np.ndarray, ids: list[np.ndarray], space: Space) -> bytes:
    """Leaf nodes over a page's vectors: pivots farthest first, each vector in the nearest pivot's node."""
    points = space.points(vectors)
    chosen = [0]
    nearest = distances(points, points[:1])[:, 0]
    node = np.zeros(len(points), dtype=np.int64)
    for k in range(1, math.ceil(len(points) / LEAF)):
        if nearest.max() <= 0:
            break
        chosen.append(int(nearest.argmax()))
        new = distances(points, points[chosen[-1:]])[:, 0]
        node[new < nearest] = k
        nearest = np.minimum(nearest, new)
    centre = points.mean(axis=0)[None, :]
    order = np.argsort(node, kind="stable")
    starts = np.searchsorted(node[order], np.arange(len(chosen) + 1))
    pivots = points[chosen]
    return packed(
        pivot=centre[0],
        radius=distances(points, centre).max(),
        node_pivot=pivots,
        node_radius=np.array([nearest[node == k].max() for k in range(len(chosen))]),
        node_parent=distances(pivots, centre)[:, 0],
        starts=starts,
        vectors=vectors[order],
        parent=nearest[order],
        ids=np.concatenate([ids[i] for i in order]),
        id_starts=np.cumsum([0, *[len(ids[i]) for i in order]]),
    )


def search_page_group(pages: list[dict], queries: np.ndarray, own: np.ndarray, least: list[int | None], space: Space, k: int) -> list[tuple[int, int, int]]:
    """(query's row, vec_id, score) for the k best of each query in these pages; own: the query's vec_id; least: what its k-th best elsewhere scores, or None."""
    found: list[tuple[int, int, int]] = []
    points = space.queries(queries)
    to_page = distances(points, np.array([p["pivot"] for p in pages]))
    to_nodes = [distances(points, p["node_pivot"]) for p in pages] if len(queries) * sum(len(p["starts"]) for p in pages) < 1 << 22 else None
    square = (points * points).sum(axis=1)
    norms, slack = np.sqrt(square), space.slack(np.sqrt(square))
    radii = np.array([float(p["radius"]) for p in pages])
    plain = np.ldexp(norms * math.sqrt(space.largest), -2 * space.power) * (1 + 1e-9) < EXACT  # double products are exact
    error = (space.width + 4) * 2.0**-52 * norms * math.sqrt(space.largest)
    for row, q in enumerate(queries):
        best: list[tuple[int, int]] = []  # heap of (score, -vec_id)
        within = lambda score, row=row: math.sqrt(max(0.0, square[row] + space.largest - 2.0 * space.scaled(score))) + slack[row]
        floor = least[row]
        reach = math.inf if floor is None else within(floor)
        queue = [(max(0.0, d), 0, n, -1) for n, d in enumerate(to_page[row] - radii)]
        heapq.heapify(queue)
        while queue:
            bound, _, n, leaf = heapq.heappop(queue)
            if bound > reach:
                break
            page = pages[n]
            if leaf < 0:
                at_most = np.abs(to_page[row, n] - page["node_parent"]) - page["node_radius"]
                for m in np.flatnonzero(at_most <= reach):
                    d = to_nodes[n][row, m] if to_nodes else distances(points[row : row + 1], page["node_pivot"][m : m + 1])[0, 0]
                    if (bound := max(0.0, d - page["node_radius"][m])) <= reach:
                        heapq.heappush(queue, (bound, 1, n, int(m)))
                continue
            lo, hi = page["starts"][leaf], page["starts"][leaf + 1]
            d = to_nodes[n][row, leaf] if to_nodes else distances(points[row : row + 1], page["node_pivot"][leaf : leaf + 1])[0, 0]
            inside = lo + np.flatnonzero(np.abs(d - page["parent"][lo:hi]) <= reach)
            if plain[row]:
                scores, doubt = page["vectors"][inside] @ q, 0.0
            else:
                scores, doubt = np.ldexp(page["vectors"][inside], space.power) @ points[row, :-1], 2 * error[row]
            if floor is not None:
                good = scores >= (floor if plain[row] else space.scaled(floor)) - doubt
                inside, scores = inside[good], scores[good]
            if len(inside) > 2 * k:
                top = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]  # own entry may be among them
                inside, scores = inside[scores >= top - doubt], scores[scores >= top - doubt]
            for e, score in zip(inside, scores, strict=True):
                score = int(score) if plain[row] else exact_score(page["vectors"][e], q)
                ids = page["ids"][page["id_starts"][e] : page["id_starts"][e + 1]].tolist()
                if own[row] in ids and np.array_equal(page["vectors"][e], q):
                    ids.remove(own[row])
                for i in ids:
                    if len(best) < k:
                        heapq.heappush(best, (score, -i))
                    elif (score, -i) > best[0]:
                        heapq.heapreplace(best, (score, -i))
            if len(best) == k and (floor is None or best[0][0] > floor):
                floor = best[0][0]
                reach = within(floor)
        found += [(row, -i, score) for score, i in best]
    return found


class Tree:
    """Pages of quantised vectors (saved: grp, split, node), and the cells over them."""

    def __init__(self, vectors: DataFrame, space: Space, k: int):
        by_id = Window.partitionBy("vec").orderBy("vec_id")
        entries = (
            vectors.withColumn("n", F.row_number().over(by_id))
            .where(F.col("n") <= k + 1)
            .groupBy("vec")
            .agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most
        )
        entries = saved(entries, "entries")
        n_entries = entries.count()
        wanted = min(MOST_PIVOTS, max(PIVOTS, n_entries // (4 * PAGE)))
        sample = entries.orderBy(F.xxhash64("vec"), "vec").limit(wanted).select("vec").collect()
        self.space, width = space, space.width
        pivots = self.pivots = space.points(matrix([r["vec"] for r in sample], width))
        n_groups = max(1, min(len(pivots), math.ceil(n_entries / PAGE / PAGES_AT_ONCE)))
        self.group_of = distances(pivots, pivots[:n_groups]).argmin(axis=1) if len(pivots) else np.zeros(0, dtype=np.int64)
        group_of = self.group_of

        def place(batches):
            for pdf in batches:
                to_pivots = distances(space.points(matrix(pdf["vec"], width)), pivots) if len(pdf) else np.zeros((0, 1))
                cell = to_pivots.argmin(axis=1)
                yield pdf.assign(cell=cell, grp=group_of[cell], d=to_pivots.min(axis=1))

        placed = saved(entries.mapInPandas(place, "vec array<double>, ids array<long>, cell int, grp int, d double"), "cells")
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("radius")).collect()  # MOST_PIVOTS rows at most
        n_slots, self.radius = [1] * max(1, len(pivots)), np.full(len(pivots), -np.inf)
        self.n_splits = np.zeros(n_groups, dtype=np.int64)
        for r in sizes:
            n_slots[r["cell"]], self.radius[r["cell"]] = math.ceil(r["n"] / PAGE), r["radius"]
            self.n_splits[group_of[r["cell"]]] += n_slots[r["cell"]]
        self.n_splits = np.maximum(1, -(-self.n_splits // PAGES_AT_ONCE))
        slot = F.pmod(F.xxhash64("vec"), F.get(constants(n_slots), F.col("cell")))

        def page(pdf: pd.DataFrame) -> pd.DataFrame:
            node = build_page(matrix(pdf["vec"], width), [np.asarray(x) for x in pdf["ids"]], space)
            return pd.DataFrame({"grp": pdf["grp"].iloc[:1], "node": [node]})

        pages = placed.withColumn("slot", slot).groupBy("cell", "slot").applyInPandas(page, "grp int, node binary")
        split = F.pmod(F.xxhash64("node"), F.get(constants(self.n_splits.tolist()), F.col("grp")))
        self.pages = saved(pages.withColumn("split", split), "tree")

    def search(self, asked: DataFrame, k: int) -> DataFrame:
        """asked: vec_id, vec, mark (tells rows apart that share a vec_id), grp, least. The k best of each in its group: query_id, mark, vec_id, score (a string)."""
        space, width = self.space, self.space.width
        counts = {r["grp"]: r["count"] for r in asked.groupBy("grp").count().collect()}  # a row for each group
        block_size = min(MOST_QUERIES, max(FEWEST_QUERIES, sum(counts.values()) // 32))
        blocks = [math.ceil(counts.get(g, 0) / block_size) for g in range(len(self.n_splits))]
        n_blocks = F.get(constants(blocks), F.col("grp"))
        block = F.when(n_blocks > 0, F.pmod(F.xxhash64("vec_id", "vec"), F.greatest(n_blocks, F.lit(1))))
        n_splits = F.get(constants(self.n_splits.tolist()), F.col("grp"))
        upto = lambda n: F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1), lambda x: x < n))

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            blob = packed(ids=pdf["vec_id"].to_numpy(np.int64), vectors=matrix(pdf["vec"], width), mark=pdf["mark"].to_numpy(np.int64), least=np.array([x or "" for x in pdf["least"]], dtype=str))
            return pd.DataFrame({"grp": pdf["grp"].iloc[:1], "block": pdf["block"].iloc[:1], "node": [blob]})

        def find(pdf: pd.DataFrame) -> pd.DataFrame:
            pages = [unpacked(x) for x in pdf.loc[~pdf["asks"], "node"]]
            out = []
            for blob in pdf.loc[pdf["asks"], "node"] if pages else []:
                q = unpacked(blob)
                least = [int(x) if x else None for x in q["least"].tolist()]
                out += [(q["ids"][r], q["mark"][r], i, str(s)) for r, i, s in search_page_group(pages, q["vectors"], q["ids"], least, space, k)]
            return pd.DataFrame(out, columns=["query_id", "mark", "vec_id", "score"])

        packs = asked.withColumn("block", block).groupBy("grp", "block").applyInPandas(pack, "grp int, block long, node binary")
        ask = packs.select("grp", upto(n_splits).alias("split"), "block", "node", F.lit(True).alias("asks"))
        dealt = self.pages.select("grp", "split", upto(n_blocks).alias("block"), "node", F.lit(False).alias("asks"))
        return ask.unionByName(dealt).groupBy("grp", "split", "block").applyInPandas(find, "query_id long, mark long, vec_id long, score string")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query (query_id, mark) with their ranks."""
    key = F.pandas_udf(lambda scores: scores.map(lambda x: order_key(int(x))), "binary")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("key"), "vec_id")
    return found.withColumn("key", key("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("key")


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each row of queries with all other rows of embeddings."""
    stored = saved(quantised(embeddings, scale), "vectors")
    asked = saved(quantised(queries, scale).groupBy("vec_id", "vec").agg(F.count("*").alias("n_same")), "queries")
    facts = F.max(F.size("vec")).alias("width"), F.max(F.array_max(F.transform("vec", lambda x: F.abs(x)))).alias("most")
    (wide, most), (width, largest) = asked.agg(*facts).first(), stored.agg(*facts).first()
    power = -max(0, math.frexp(max(most or 0.0, largest or 0.0))[1] - 400)
    unit = F.lit(math.ldexp(1.0, power))
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x * unit) * (x * unit))
    space = Space(max(width or 0, wide or 0), power, stored.agg(F.max(norm)).first()[0] or 0.0)
    tree = Tree(stored, space, k)
    pivots, group_of, radius = tree.pivots, tree.group_of, tree.radius

    def at_home(batches):
        for pdf in batches:
            cell = distances(space.queries(matrix(pdf["vec"], space.width)), pivots).argmin(axis=1) if len(pdf) and len(pivots) else np.zeros(len(pdf), dtype=np.int64)
            yield pdf.assign(grp=group_of[cell] if len(group_of) else cell)

    marked = asked.select("vec_id", "vec", F.xxhash64("vec").alias("mark"), F.lit(None).cast("string").alias("least"))
    home = saved(marked.mapInPandas(at_home, "vec_id long, vec array<double>, mark long, least string, grp int"), "asked")
    found = saved(tree.search(home, k), "found")
    if len(tree.n_splits) > 1:

        def elsewhere(batches):
            for pdf in batches:
                points = space.queries(matrix(pdf["vec"], space.width))
                norms = np.sqrt((points * points).sum(axis=1))
                scores = np.array([-math.inf if x is None else space.scaled(int(x)) for x in pdf["least"]])
                reach = np.sqrt(np.maximum(0.0, norms**2 + space.largest - 2 * scores)) + space.slack(norms)
                near = distances(points, pivots) - radius[None, :] <= reach[:, None]  # cells that are not out of reach
                groups = [[g for g in np.unique(group_of[cells]).tolist() if g != own] for cells, own in zip(near, pdf["grp"], strict=True)]
                yield pdf.assign(grp=groups).explode("grp").dropna(subset="grp").astype({"grp": "int32"})

        kth = best_of(found, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "mark", F.col("score").alias("least"))
        bounded = home.drop("least").join(kth, ["vec_id", "mark"], "left").select("vec_id", "vec", "mark", "least", "grp")
        others = saved(bounded.mapInPandas(elsewhere, "vec_id long, vec array<double>, mark long, least string, grp int"), "asked")
        found = found.unionByName(saved(tree.search(others, k), "found"))
    edge = F.when(F.col("score").startswith("-"), F.lit(-(2**63))).otherwise(F.lit(2**63 - 1))
    whole = F.coalesce(F.expr("try_cast(score as bigint)"), edge)
    repeats = asked.where("n_same > 1").select(F.col("vec_id").alias("query_id"), F.xxhash64("vec").alias("mark"), "n_same")
    return (
        best_of(found, k).join(repeats, ["query_id", "mark"], "left")
        .withColumn("copy", F.explode(F.expr("array_repeat(0, int(coalesce(n_same, 1)))")))
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", whole.alias("score"))
    )
