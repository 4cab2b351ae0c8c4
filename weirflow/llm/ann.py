"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a sample of distinct vectors (``SAMPLE_BYTES`` of them); a leaf that turns out to hold more than ``SPLIT`` times
``LEAF`` vectors is split further by a tree of its own, fitted in a task on at most ``SUB`` of its vectors, so leaves grow in number with
the table, up to ``MOST_NODES`` centres. Every vector is then placed in a leaf. A query walks the tree best bin first: a priority
queue holds the children passed on the way, by an estimate of the best inner product in them (the centre's, plus ``reach`` times
the radius), and yields leaf after leaf. After the first few leaves each query stops by itself, where the estimates fall behind what
it may still need: a threshold from its best matches in a small sample, less a slack. Reach, first visits and slack are calibrated:
``CALIBRATION`` queries are held against all vectors, and the slack is widened until their recall reaches the target.

Equal vectors are one class, so a vector that fills a third of the table is searched once; its smallest ids
stand for it, which are all that a result can show. Neighbouring leaves make groups of about ``CELL`` vectors; groups and the queries
that visit any of their leaves meet in cells of bounded size on both sides, where a query sees the leaves that it visits, and each
cell returns at most k neighbours for each of its queries.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm import _text as T
from weirflow.llm._shared import bounded, forget, place, renamed, written

SAMPLE_BYTES, CALIBRATION, GAUGE = 32 << 20, 200, 4096
#: Matches in the gauge that a threshold rests on at least; fewer would hang on single near copies.
RANK = 16
LEAF, BRANCH, STEPS, SPLIT, SUB = 512, 8, 8, 4, 8192
#: Centres of the whole tree; beyond, leaves hold more.
MOST_NODES = 250_000
CELL = 4096
#: What calibration tries: parts of the radius, and shares of the leaves that every query visits.
REACHES, FIRST = (0.0, 0.5, 1.0), (0.0, 0.1, 0.25, 0.4, 0.55, 0.7, 0.85)
#: Recall below which a query is left behind, and the share of such queries that a rule may have.
LOW, FEW_LOW = 0.8, 0.02


@dataclass
class Tree:
    """centres, radii: one row for each node (root mean square of the distances); children: of each node; leaf: number of a leaf or -1, in the order of a walk."""

    centres: np.ndarray
    radii: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __post_init__(self):
        self.leaf = np.full(len(self.centres), -1)
        todo, n = [0], 0
        while todo:
            at = todo.pop()
            if self.children[at]:
                todo.extend(reversed(self.children[at]))
            else:
                self.leaf[at], n = n, n + 1
        self.leaves = n

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down the nearest centres."""
        node = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if not self.children[at]:
                node[rows] = at
                continue
            kids = np.array(self.children[at])
            c = self.centres[kids]
            best = ((c * c).sum(1) - 2 * x[rows] @ c.T).argmin(1)
            todo.extend((int(k), rows[best == i]) for i, k in enumerate(kids) if (best == i).any())
        return self.leaf[node]

    def visits(self, q: np.ndarray, reach: float = 0.0) -> Iterator[tuple[int, float]]:
        """Leaves in best-bin-first order with their estimates, which do not rise."""
        score = self.centres @ q + reach * np.linalg.norm(q) * self.radii
        heap = [(-np.inf, 0)]
        while heap:
            key, at = heapq.heappop(heap)
            if self.children[at]:
                for k in self.children[at]:
                    heapq.heappush(heap, (max(-score[k], key), k))
            else:
                yield int(self.leaf[at]), -key

    def grafted(self, trees: dict[int, Tree]) -> Tree:
        """The tree with others in place of some leaves."""
        centres, radii, children = [self.centres], [self.radii], [list(c) for c in self.children]
        n = len(self.centres)
        for at in np.flatnonzero(self.leaf >= 0).tolist():
            t = trees.get(int(self.leaf[at]))
            if t is not None and t.leaves > 1:
                # its root is the leaf's node, its other nodes come behind all
                children[at] = [n + k - 1 for k in t.children[0]]
                children += [[n + k - 1 for k in c] for c in t.children[1:]]
                centres.append(t.centres[1:])
                radii.append(t.radii[1:])
                n += len(t.centres) - 1
        return Tree(np.concatenate(centres), np.concatenate(radii), children)


def grow(x: np.ndarray, least: int, seed: int = 3) -> Tree:
    """Splits by k-means until a node has at most ``least`` vectors."""
    rng = np.random.default_rng(seed)
    spread = lambda own, c: float(np.sqrt(((own - c) ** 2).sum(1).mean()))
    centres, children = [x.mean(0)], [[]]
    radii = [spread(x, centres[0])]
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        own = x[rows]
        k = min(BRANCH, -(-len(rows) // least))
        if k <= 1:
            continue
        c = own[rng.choice(len(own), k, replace=False)]
        for _ in range(STEPS):
            near = ((c * c).sum(1) - 2 * own @ c.T).argmin(1)
            c = np.stack([own[near == i].mean(0) if (near == i).any() else c[i] for i in range(k)])
        near = ((c * c).sum(1) - 2 * own @ c.T).argmin(1)
        parts = [i for i in range(k) if (near == i).any()]
        if len(parts) > 1:
            for i in parts:
                children[at].append(len(centres))
                todo.append((len(centres), rows[near == i]))
                centres.append(c[i])
                radii.append(spread(own[near == i], c[i]))
                children.append([])
    return Tree(np.stack(centres), np.array(radii), children)


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


@T.trimmed
def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles."""
    for b in batches:
        v = b.column("v")
        offs, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("low"), pa.array([flat[a:z].tobytes() for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], pa.binary()), b.column("asks")], ["rep", "low", "v", "asks"])


def _place(spread, dim: int):
    @T.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("low"), b.column("v"), pa.array(spread.value.place(_matrix(b.column("v"), dim)))], ["rep", "low", "v", "leaf"])

    return run


def _grow_in(dim: int, sizes: dict[int, int]):
    """A tree for the sample of one leaf."""

    @T.trimmed
    def run(t: pa.Table) -> pa.Table:
        leaf, x = t.column("leaf")[0].as_py(), _matrix(t.column("v"), dim)
        tree = grow(x, max(8, len(x) * LEAF // max(sizes[leaf], LEAF)))
        return pa.table({"leaf": pa.array([leaf], pa.int64()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return run


@dataclass
class Search:
    """What a query needs: the tree, the leaves' sizes and groups, a few vectors to gauge its threshold by, reach and slack."""

    tree: Tree
    sizes: np.ndarray
    group: np.ndarray
    gauge: np.ndarray
    rank: int
    reach: float = 0.0
    first: int = 0
    slack: float = np.inf

    def need(self, q: np.ndarray) -> np.ndarray:
        """The score that each query's k-th match is expected to have, by its matches among a few vectors, itself left out."""
        score, own = q @ self.gauge.T, (q * q).sum(1)[:, None]
        score[own + (self.gauge * self.gauge).sum(1) - 2 * score < 1e-9 * own] = -np.inf
        best = -np.partition(-score, self.rank - 1, axis=1)[:, self.rank - 1]
        return np.where(np.isfinite(best), best, 0.0)

    def leaves(self, q: np.ndarray, need: float, least: int) -> list[int]:
        own, held, low = [], 0, need - self.slack * float(np.linalg.norm(q))
        for leaf, key in self.tree.visits(q, self.reach):
            if key < low and held >= least and len(own) >= self.first:
                break
            own.append(leaf)
            held += int(self.sizes[leaf])
        return own

    def calibrated(self, q: np.ndarray, truth: dict[int, list[int]], recall: float) -> Search:
        """Of a few reaches and first visits, those by which the calibration queries see the fewest vectors at the target recall, with the slack that this takes; rules that leave too many single queries behind only if there are no others.

        ``truth``: the leaves of each query's neighbours.
        """
        need, size, found = self.need(q), np.linalg.norm(q, axis=1), []
        who = np.repeat(list(truth), [len(x) for x in truth.values()]) if truth else np.zeros(0, np.int64)
        want = int(np.ceil(recall * len(who)))
        for reach in REACHES:
            walks = [list(self.tree.visits(x, reach)) for x in q]
            spot = [{leaf: i for i, (leaf, _) in enumerate(w)} for w in walks]
            held = [np.concatenate([[0], np.cumsum([self.sizes[leaf] for leaf, _ in w])]) for w in walks]
            behind = [(need[i] - np.array([key for _, key in w])) / size[i] for i, w in enumerate(walks)]  # rises along the walk
            at = np.array([spot[i][leaf] for i, own in truth.items() for leaf in own], np.int64)
            gap = np.array([behind[i][spot[i][leaf]] for i, own in truth.items() for leaf in own])
            for share in FIRST:
                first = int(np.ceil(share * self.tree.leaves))
                open_ = np.sort(gap[at >= first])
                more = want - int((at < first).sum())
                slack = float(open_[more - 1]) + 1e-12 if more > 0 else -np.inf
                hit = (at < first) | (gap <= slack)
                low = np.bincount(who, hit, len(q))[list(truth)] < LOW * np.bincount(who, minlength=len(q))[list(truth)]
                cost = sum(int(h[max(first, int(np.searchsorted(b, slack, "right")))]) for h, b in zip(held, behind, strict=True))
                found.append((bool(low.mean() > FEW_LOW) if len(low) else False, cost, reach, first, slack))
        _, _, self.reach, self.first, self.slack = min(found)
        return self


def _visit(spread, dim: int, least: int):
    """Each query once for each group that it visits leaves of."""

    @T.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search: Search = spread.value
        for b in batches:
            q = _matrix(b.column("v"), dim)
            if not len(q):
                continue
            rows, groups, leaves = [], [], []
            for i, need in enumerate(search.need(q).tolist()):
                own = np.array(search.leaves(q[i], need, least))
                for g in np.unique(search.group[own]).tolist():
                    rows.append(i)
                    groups.append(g)
                    leaves.append(own[search.group[own] == g].tolist())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("rep").take(at), b.column("v").take(at), pa.array(groups, pa.int64()), pa.array(leaves, pa.list_(pa.int64()))], ["rep", "v", "g", "leaves"])

    return run


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Places of the k best of each row: largest score, then smallest id."""
    for row in score:
        at = np.arange(len(row))
        if len(row) > k:
            at = np.flatnonzero(row >= -np.partition(-row, k - 1)[k - 1])
        yield at[np.lexsort((ids[at], -row[at]))[:k]]


_NEAR = pa.list_(pa.struct([("far", pa.float64()), ("low", pa.int64()), ("rep", pa.int64())]))


def _meet(dim: int, k: int):
    @T.trimmed
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "near": pa.array([], _NEAR)})
        order = np.argsort(right.column("leaf").to_numpy(), kind="stable")
        right = right.take(pa.array(order))
        ids, low, v = right.column("rep").to_numpy(), right.column("low").to_numpy(), _matrix(right.column("v"), dim)
        own, where = np.unique(right.column("leaf").to_numpy(), return_inverse=True)
        near, kept = [], []
        q = _matrix(left.column("v"), dim)
        leaves = left.column("leaves").combine_chunks()
        offs, flat = leaves.offsets.to_numpy(), leaves.values.to_numpy()
        for at in range(0, len(q), 256):
            to = min(at + 256, len(q))
            asked = np.zeros((to - at, len(own) + 1), bool)
            mine = flat[offs[at] : offs[to]]
            spot = np.minimum(np.searchsorted(own, mine), len(own) - 1)
            spot = np.where(own[spot] == mine, spot, len(own))  # leaves that lie in another block
            asked[np.repeat(np.arange(to - at), np.diff(offs[at : to + 1])), spot] = True
            score = np.where(asked[:, where], q[at:to] @ v.T, -np.inf)
            for i, (row, best) in enumerate(zip(score, _best(score, low, k), strict=True)):
                best = best[row[best] > -np.inf].tolist()
                if best:
                    kept.append(at + i)
                    near.append([{"far": float(-row[j]), "low": int(low[j]), "rep": int(ids[j])} for j in best])
        return pa.table({"q": left.column("rep").combine_chunks().take(pa.array(kept, pa.int64())), "near": pa.array(near, _NEAR)})

    return run


def _brute(spread, dim: int, k: int):
    """Best of each partition for a few queries."""

    @T.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs, q = spread.value
        ids, leaf, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((len(qs), 0))
        for b in batches:
            if not b.num_rows:
                continue
            ids, leaf = np.concatenate([ids, b.column("rep").to_numpy()]), np.concatenate([leaf, b.column("leaf").to_numpy()])
            score = np.concatenate([score, q @ _matrix(b.column("v"), dim).T], axis=1)
            if score.shape[1] > 20_000:
                keep = np.unique(np.concatenate(list(_best(score, ids, k))))
                ids, leaf, score = ids[keep], leaf[keep], score[:, keep]
        out = [(int(qs[i]), int(ids[j]), float(score[i, j]), int(leaf[j])) for i, best in enumerate(_best(score, ids, k)) for j in best.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["q", "rep", "score", "leaf"])

    return run


def nearest(vectors: DataFrame, query: Column, *, k: int = 20, recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found by inner product for each row where ``query`` holds: query_id, rank (from 1), vec_id, score.

    Candidates are all rows but those with the query's id; ties go to the smaller id; with fewer candidates all are
    returned. Vectors that are null, empty, zero, hold null or non-finite components, or are not of the most common length,
    take no part, nor do rows with a null id. Rows that repeat an id with another vector are candidates each. Other columns
    are ignored; an empty table gives an empty result.
    """
    spark = bounded(vectors)
    base, inner = renamed(vectors.select("*", F.coalesce(query, F.lit(False))))
    rows = base.select(F.col(inner[place(vectors, id_col)]).cast("long").alias("vec_id"), F.col(inner[place(vectors, vector_col)]).cast("array<double>").alias("v"), F.col(inner[-1]).alias("asks"))
    rows = rows.where("vec_id is not null and v is not null").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    rows = rows.withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(7), "v")})
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    dim = lengths[0]["d"]
    rows = rows.where(F.size("v") == dim)
    classes = rows.groupBy("h", "g").agg(F.min("vec_id").alias("low"), F.max("asks").alias("asks"), F.first("v").alias("v"))
    # a class is named by its hash, as an id may repeat with other vectors; its smallest id decides ties between classes
    raw = written(classes.select(F.xxhash64("h", "g").alias("rep"), "low", "v", "asks").mapInArrow(_raw, "rep long, low long, v binary, asks boolean"), "vectors")
    sample = raw.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(max(CALIBRATION, SAMPLE_BYTES // (8 * dim))).toPandas()
    x = np.frombuffer(b"".join(sample["v"]), np.float64).reshape(-1, dim)
    total = raw.count()
    tree = grow(x, max(8, len(x) * LEAF // max(total, LEAF)))

    def placed_by(tree: Tree) -> tuple[DataFrame, np.ndarray]:
        spread = spark.sparkContext.broadcast(tree)
        placed = written(raw.select("rep", "low", "v").mapInArrow(_place(spread, dim), "rep long, low long, v binary, leaf long"), "placed")
        sizes = np.zeros(tree.leaves, np.int64)
        for r in placed.groupBy("leaf").count().collect():  # one row a leaf
            sizes[r["leaf"]] = r["count"]
        return placed, sizes

    placed, sizes = placed_by(tree)
    large = {int(i): int(sizes[i]) for i in np.argsort(-sizes, kind="stable").tolist() if sizes[i] > SPLIT * LEAF}
    room, split = MOST_NODES - len(tree.centres), {}
    for i, n in large.items():
        room -= 2 * n // LEAF
        if room < 0:
            break
        split[i] = n
    if split:
        some = placed.join(F.broadcast(spark.createDataFrame([(i,) for i in split], "leaf long")), "leaf").select("leaf", "v", F.xxhash64("rep").alias("o"), "rep")
        some = some.withColumn("i", F.row_number().over(Window.partitionBy("leaf").orderBy("o", "rep"))).where(F.col("i") <= SUB).select("leaf", "v")
        grown = written(some.groupBy("leaf").applyInArrow(_grow_in(dim, split), "leaf long, tree binary"), "trees")
        tree = tree.grafted({r.leaf: pickle.loads(r.tree) for r in grown.collect()})
        forget(placed, grown)
        placed, sizes = placed_by(tree)

    asking = raw.where("asks").select("rep", "low", "v")
    few = asking.orderBy(F.xxhash64("rep", F.lit(1)), "rep").limit(CALIBRATION).toPandas()
    if not len(few):
        return spark.createDataFrame([], schema)
    q = np.frombuffer(b"".join(few["v"]), np.float64).reshape(-1, dim)
    held = spark.sparkContext.broadcast((few["rep"].to_numpy(), q))
    truth = placed.mapInArrow(_brute(held, dim, k + 1), "q long, rep long, score double, leaf long")
    truth = truth.withColumn("i", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))).where(F.col("i") <= k + 1).where("q != rep").select("q", "leaf").collect()
    number = {int(r): i for i, r in enumerate(few["rep"])}
    leaves: dict[int, list[int]] = {}
    for r in truth:
        leaves.setdefault(number[r.q], []).append(r.leaf)
    gauge = x[: min(len(x), GAUGE)]
    search = Search(tree, sizes, np.cumsum(sizes) // CELL, gauge, min(len(gauge), max(RANK, round(k * len(gauge) / max(total, 1)))))
    spread = spark.sparkContext.broadcast(search.calibrated(q, leaves, recall))

    asked = written(asking.mapInArrow(_visit(spread, dim, 2 * k + 2), "rep long, v binary, g long, leaves array<long>"), "visits")
    held_by: dict[int, int] = {}
    for g, n in zip(search.group.tolist(), sizes.tolist(), strict=True):
        held_by[g] = held_by.get(g, 0) + n
    waiting = {r["g"]: r["count"] for r in asked.groupBy("g").count().collect()}  # one row a group
    blocks = F.broadcast(spark.createDataFrame([(g, -(-n // (2 * CELL)) or 1, -(-waiting.get(g, 0) // CELL) or 1) for g, n in held_by.items()], "g long, nv int, nq int"))
    groups = F.broadcast(spark.createDataFrame(list(enumerate(search.group.tolist())), "leaf long, g long"))  # one row a leaf, at most MOST_NODES

    one = _cells(asked.join(blocks, "g"), "nq", "nv", "qb", "vb").select("g", "qb", "vb", "rep", "v", "leaves")
    two = _cells(placed.join(groups, "leaf").join(blocks, "g"), "nv", "nq", "vb", "qb").select("g", "qb", "vb", "rep", "low", "v", "leaf")
    key = ("g", "qb", "vb")
    met = one.groupBy(*key).cogroup(two.groupBy(*key)).applyInArrow(_meet(dim, k + 1), "q long, near array<struct<far:double,low:long,rep:long>>")
    best = met.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))  # at most k + 1 for each cell visited

    # classes back to rows: only the smallest ids of a class can show
    ids = rows.select("vec_id", F.xxhash64("h", "g").alias("rep")).distinct()
    ids = ids.withColumn("i", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).where(F.col("i") <= k + 1).groupBy("rep").agg(F.collect_list("vec_id").alias("ids"))
    pairs = best.select("q", F.explode("near").alias("x")).select("q", F.col("x.far").alias("far"), F.col("x.rep").alias("rep")).join(ids, "rep")
    listed = pairs.groupBy("q").agg(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("far").alias("far"), i.alias("id")))).alias("l"))
    listed = listed.select("q", F.slice(F.array_sort(F.flatten("l")), 1, 3 * (k + 1)).alias("l"))
    askers = rows.where("asks").select("vec_id", F.xxhash64("h", "g").alias("q")).distinct()
    found = askers.join(listed, "q").select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(F.filter("l", lambda x: x["id"] != F.col("vec_id")), 1, k)).alias("i", "x"))
    return found.select("query_id", (F.col("i") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def _cells(df: DataFrame, own: str, other: str, own_block: str, other_block: str) -> DataFrame:
    """Deals rows to their side's blocks of a group, and copies them to the other side's blocks."""
    return df.withColumn(own_block, F.pmod(F.xxhash64("rep", F.lit(2)), F.col(own)).cast("int")).withColumn(other_block, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
