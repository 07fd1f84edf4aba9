"""Embedding near-dedup over a robust-pruned flat graph.

Vectors of one label link at a cosine of ``THRESHOLD`` or more, in double precision. Equal vectors
are one node with a count before anything else. The nodes of each label are cut into overlapping
shards around centroids: each goes to its ``overlap`` nearest. On every shard a graph is built by insertion with
robust pruning (Subramanya et al., 2019): nodes come in batches, each is searched in the graph so far, greedily from the
medoids, and what its search met is pruned (a candidate is dropped if a kept one is nearer to it than
the node, by the factor ``ALPHA``) to its neighbours, which link back. The adjacency lists of all shards are united, and every node is
searched in its shards: greedily from the shard's medoids to its neighbourhood, then outwards
through every node within the range until no more are found. Each pair found is verified, and
counted in one shard only, the first that both nodes are in.

Recall is audited node by node: the links of sampled nodes, some of them nodes with links, are counted by brute force against all vectors,
in blocks, and recall is the mean over the nodes. Below ``RECALL`` the search is repeated with twice the overlap and a wider beam, and at
last without shards, where all pairs of blocks of a label are compared.

Memory: a task holds one shard or two blocks of one. Shards above ``BLOCK`` nodes are cut into
blocks and all pairs of blocks are searched, so no hot label or dense cluster meets in one task. Up to ``FLAT`` centroids are fitted
on the driver from at most ``SAMPLE`` vectors; more are a tree of two levels, whose second is fitted in tasks: ``MOST_CENTROIDS`` at
most, 78 million vectors, beyond which shards grow.

Vectors that are null, zero, or hold null or non-finite components, and rows without a label or an id,
link with nothing. Ids are integers. Vectors of different lengths don't link. Repeated ids are separate rows, linked by their vectors only;
a row is kept where its id is its component's. Ties: equal cosines are all links. Vectors may have any length that a task holds ``BLOCK`` of.
Columns are read by the names given, so extra ones of any name are passed over; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, release, spread_join
from .graph import components

THRESHOLD = 0.93
RECALL = 0.99
SHARD = 600
BLOCK = 1200
SAMPLE = 20_000
FLAT = 1024
MOST_CENTROIDS = 65_536
MOST_LABELS = 4096
OVERLAP = 2
BEAM = 8
DEGREE = 20
#: Nodes of a search that are candidates for neighbours, nodes inserted together, and how many of these are candidates too.
POOL = 16
BATCH = 128
MATES = 12
ALPHA = 1.2
MEDOIDS = 16
AUDITED = 192
#: Nodes a little below the threshold are expanded too: their neighbours may be above it.
SLACK = 0.05
ROUNDS = ((1, 1), (2, 2), (0, 0))
PAIRS_AT_ONCE = 200_000


def usable(vector: Column, label: Column) -> Column:
    numbers = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return label.isNotNull() & vector.isNotNull() & F.coalesce(fine & F.exists(numbers, lambda x: x != 0), F.lit(False))


def unit(vectors) -> np.ndarray:
    made = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    made = made / np.abs(made).max(axis=1, keepdims=True)
    return made / np.linalg.norm(made, axis=1, keepdims=True)


def fit_centroids(vectors: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means, started from points spread over the sample."""
    centroids = vectors[np.linspace(0, len(vectors) - 1, min(count, len(vectors))).astype(int)]
    for _ in range(rounds):
        nearest = (vectors @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, vectors)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
    return centroids


def medoids(x: np.ndarray, count: int = MEDOIDS) -> np.ndarray:
    """The medoid, and those of coarse clusters around points far from each other."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[chosen[0]]
    for _ in range(min(count, len(x)) - 1):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    cluster = (x @ x[chosen].T).argmax(axis=1)
    found = [chosen[0]]
    for c in range(len(chosen)):
        mine = np.flatnonzero(cluster == c)
        if len(mine):
            found.append(int(mine[(x[mine] @ x[mine].mean(axis=0)).argmax()]))
    return np.unique(found)


def pruned(x: np.ndarray, rows: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each of ``rows`` the neighbours that robust pruning leaves of its ``candidates`` (-1: none), nearest first."""
    out = np.full((len(rows), degree), -1)
    for at in range(0, len(rows), 256):
        own, near = rows[at : at + 256], candidates[at : at + 256]
        cosine = np.matmul(x[near], x[own][:, :, None])[:, :, 0]
        cosine[(near < 0) | (near == own[:, None])] = -2
        order = np.argsort(-cosine, axis=1, kind="stable")
        near, cosine = np.take_along_axis(near, order, 1), np.take_along_axis(cosine, order, 1)
        others = x[near]
        apart, away, alive = 1 - others @ others.transpose(0, 2, 1), 1 - cosine, cosine > -1.5
        every = np.arange(len(own))
        for k in range(min(degree, near.shape[1])):
            some = alive.any(axis=1)
            if not some.any():
                break
            best = alive.argmax(axis=1)
            out[at + every[some], k] = near[every, best][some]
            alive &= alpha * apart[every, best] > away
            alive[every, best] = False
    return out


def _link_back(x: np.ndarray, adjacency: np.ndarray, sources: np.ndarray, alpha: float) -> None:
    """Every neighbour of ``sources`` gets them for neighbours; lists that run over are pruned."""
    a, k = np.nonzero(adjacency[sources] >= 0)
    ends, new = adjacency[sources][a, k], sources[a]
    order = np.argsort(ends, kind="stable")
    ends, new = ends[order], new[order]
    targets, first, count = np.unique(ends, return_index=True, return_counts=True)
    degree = adjacency.shape[1]
    held = (adjacency[targets] >= 0).sum(axis=1)
    number = np.repeat(np.arange(len(targets)), count)
    place = np.arange(len(ends)) - first[number]
    fits = held + count <= degree
    mine = fits[number]
    adjacency[ends[mine], held[number][mine] + place[mine]] = new[mine]
    if not fits.all():
        over = np.flatnonzero(~fits)
        wide = np.full((len(over), degree + int(count[over].max())), -1)
        wide[:, :degree] = adjacency[targets[over]]
        slot = np.full(len(targets), -1)
        slot[over] = np.arange(len(over))
        wide[slot[number][~mine], degree + place[~mine]] = new[~mine]
        adjacency[targets[over]] = pruned(x, targets[over], wide, degree, alpha)


def build(x: np.ndarray, degree: int = DEGREE, pool: int = POOL, alpha: float = ALPHA) -> np.ndarray:
    """Adjacency rows (-1: none) of the robust-pruned graph over unit vectors ``x``, built by searching each node in the graph so far."""
    x, n = x.astype(np.float32), len(x)
    adjacency = np.full((n, degree), -1)
    entry = medoids(x)
    rest = np.setdiff1d(np.arange(n), entry)
    np.random.default_rng(n).shuffle(rest)
    adjacency[entry] = pruned(x, entry, np.tile(entry, (len(entry), 1)), degree, alpha)
    _link_back(x, adjacency, entry, alpha)
    at = 0
    while at < len(rest):
        batch = rest[at : at + min(BATCH, len(entry) + at)]
        at += len(batch)
        found, _ = greedy(x, adjacency, batch, entry, pool, np.zeros((len(batch), n), dtype=bool))
        among = x[batch] @ x[batch].T
        np.fill_diagonal(among, -2)
        mates = batch[np.argsort(-among, axis=1, kind="stable")[:, : min(MATES, len(batch) - 1)]]
        adjacency[batch] = pruned(x, batch, np.concatenate([found, mates], axis=1), degree, alpha)
        _link_back(x, adjacency, batch, alpha)
    return adjacency


def greedy(x: np.ndarray, adjacency: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int, seen: np.ndarray, visit=None) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, cosines): the ``width`` nearest that each query's search from ``entry`` keeps (-1: none), nearest first.

    ``seen`` (queries by nodes) is marked; ``visit`` is told (query's place, node, cosine) of all that is met.
    """
    cosine = x[queries] @ x[entry].T
    order = np.argsort(-cosine, axis=1, kind="stable")[:, :width]
    ids, sims = np.full((len(queries), width), -1), np.full((len(queries), width), -2.0)
    ids[:, : order.shape[1]], sims[:, : order.shape[1]] = entry[order], np.take_along_axis(cosine, order, 1)
    seen[:, entry] = True
    if visit:
        q, c = np.indices(cosine.shape).reshape(2, -1)
        visit(q, entry[c], cosine.reshape(-1))
    done, live = ids < 0, np.arange(len(queries))
    while len(live):
        at = np.where(done[live], -3.0, sims[live]).argmax(axis=1)
        open_ = ~done[live, at]
        live, at = live[open_], at[open_]
        if not len(live):
            break
        done[live, at] = True
        next_ = adjacency[ids[live, at]]
        fresh = (next_ >= 0) & ~seen[live[:, None], next_]
        row, c = np.nonzero(fresh)
        q, node = live[row], next_[row, c]
        seen[q, node] = True
        value = np.einsum("ij,ij->i", x[queries[q]], x[node])
        if visit:
            visit(q, node, value)
        new = np.full((len(live), next_.shape[1]), -2.0)
        new[fresh] = value
        ids2 = np.concatenate([ids[live], np.where(fresh, next_, -1)], axis=1)
        sims2 = np.concatenate([sims[live], new], axis=1)
        done2 = np.concatenate([done[live], ~fresh], axis=1)
        order = np.argsort(-sims2, axis=1, kind="stable")[:, :width]
        ids[live], sims[live], done[live] = (np.take_along_axis(m, order, 1) for m in (ids2, sims2, done2))
    return ids, sims


def united(lists: list[np.ndarray], n: int) -> np.ndarray:
    """One adjacency matrix of all edges in ``lists`` ((k, 2) arrays of node places), both ways."""
    edges = np.concatenate([np.zeros((0, 2), dtype=np.int64), *lists])
    edges = np.unique(np.concatenate([edges, edges[:, ::-1]]), axis=0)
    edges = edges[(edges[:, 0] != edges[:, 1])]
    place = np.arange(len(edges)) - np.searchsorted(edges[:, 0], edges[:, 0])
    out = np.full((n, int(place.max()) + 1 if len(edges) else 1), -1)
    out[edges[:, 0], place] = edges[:, 1]
    return out


def _beyond(x: np.ndarray, frontier: np.ndarray, adjacency: np.ndarray, seen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, nodes, cosines) next to the frontier's (query, node) pairs that weren't seen, in parts.

    In a dense cluster the same neighbours come up again and again; there a product of the frontier with
    the adjacency finds each once.
    """
    n, degree = adjacency.shape
    if len(frontier) * degree > n * n // 8:
        edges = np.zeros((n, n), dtype=np.float32)
        at, k = np.nonzero(adjacency >= 0)
        edges[at, adjacency[at, k]] = 1
        frontier = frontier[np.argsort(frontier[:, 0], kind="stable")]
        for low in range(0, n, 512):
            a, b = np.searchsorted(frontier[:, 0], (low, low + 512))
            if a < b:
                held = np.zeros((min(512, n - low), n), dtype=np.float32)
                held[frontier[a:b, 0] - low, frontier[a:b, 1]] = 1
                fresh = (held @ edges > 0) & ~seen[low : low + 512]
                q, node = np.nonzero(fresh)
                yield q + low, node, (x[low : low + 512] @ x.T)[fresh]
        return
    step = max(1, PAIRS_AT_ONCE // degree)
    for k in range(0, len(frontier), step):
        part = frontier[k : k + step]
        node = adjacency[part[:, 1]]
        q = np.broadcast_to(part[:, :1], node.shape)
        fresh = (node >= 0) & ~seen[q, node]
        pairs = np.unique(q[fresh] * n + node[fresh])
        q, node = pairs // n, pairs % n
        yield q, node, np.einsum("ij,ij->i", x[q], x[node])


def search(x: np.ndarray, adjacency: np.ndarray, threshold: float = THRESHOLD, beam: int = BEAM) -> np.ndarray:
    """A symmetric matrix: which pairs the searches of all nodes found at ``threshold`` or more."""
    n = len(x)
    seen, linked = np.zeros((n, n), dtype=bool), np.zeros((n, n), dtype=bool)
    near: list[np.ndarray] = []

    def visit(q: np.ndarray, node: np.ndarray, value: np.ndarray) -> None:
        linked[q, node] = value >= threshold
        close = value >= threshold - SLACK
        near.append(np.column_stack([q[close], node[close]]))

    every = np.arange(n)
    greedy(x, adjacency, every, medoids(x), max(beam, 1), seen, visit)
    frontier = np.concatenate(near)
    while len(frontier):
        near.clear()
        for q, node, value in _beyond(x, frontier, adjacency, seen):
            seen[q, node] = True
            visit(q, node, value)
        frontier = np.concatenate(near)
    linked[every, every] = False
    return linked | linked.T


def forest(linked: np.ndarray) -> np.ndarray:
    """The least place that each node reaches."""
    root = np.arange(len(linked))
    while True:
        now = np.minimum(root, np.where(linked, root[None, :], len(linked)).min(axis=1, initial=len(linked)))
        now = now[now]
        if (now == root).all():
            return root
        root = now


_GROUP = ["label", "shard", "i", "j"]
_EDGES = "node long, next long"
_FOUND = "node long, links long, pairs long, root long"


def _build_group(pdf: pd.DataFrame) -> pd.DataFrame:
    x, nodes = unit(pdf["v"]), pdf["node"].to_numpy()
    adjacency = build(x)
    a, b = np.nonzero(adjacency >= 0)
    return pd.DataFrame({"node": nodes[a], "next": nodes[adjacency[a, b]]})


def _search_group(beam: int, threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        x, nodes, n = unit(pdf["v"]), pdf["node"].to_numpy(), len(pdf)
        counts, block = pdf["n"].to_numpy(), pdf["block"].to_numpy()
        shard, i, j = (int(pdf[c].iloc[0]) for c in ("shard", "i", "j"))
        if beam:
            edges = []
            for k, nexts in enumerate(pdf["nexts"]):
                ends = np.asarray(nexts if nexts is not None else [], dtype=np.int64)
                at = np.minimum(np.searchsorted(nodes, ends), n - 1)
                at = at[nodes[at] == ends] if n else at
                edges.append(np.column_stack([np.full(len(at), k), at]))
            linked = search(x, united(edges, n), threshold, beam)
        else:  # the exact way: all pairs
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
        if i != j:
            linked &= block[:, None] != block[None, :]
        width = max(map(len, pdf["shards"]))
        shards = np.full((n, width), -1)
        for k, own in enumerate(pdf["shards"]):
            shards[k, : len(own)] = own
        a, b = np.nonzero(linked)
        earlier = np.zeros(len(a), dtype=bool)
        for s in range(width):
            for t in range(width):
                earlier |= (shards[a, s] == shards[b, t]) & (shards[a, s] >= 0) & (shards[a, s] < shard)
        links = np.bincount(a[~earlier], counts[b[~earlier]], n).astype(np.int64)
        pairs = np.bincount(a[~earlier], minlength=n).astype(np.int64)
        return pd.DataFrame({"node": nodes, "links": links, "pairs": pairs, "root": nodes[forest(linked)]})

    return run


def _fit_leaves(leaves: dict):
    """Fits the second level's centroids of one cell of the first; ``leaves``: how many a sampled vector stands for, by label."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(pdf["v"])
        made = fit_centroids(x, max(1, round(len(x) * leaves[int(pdf["number"].iloc[0])])))
        return pd.DataFrame({"number": [pdf["number"].iloc[0]], "top": [pdf["top"].iloc[0]], "made": [made.astype(np.float32).tobytes()]})

    return run


@dataclass
class Tree:
    """Centroids of one label and length of vectors: of the first level, and below each those of the second with the number of the first."""

    tops: np.ndarray
    below: list[tuple[int, np.ndarray]] | None = None

    def nearest(self, x: np.ndarray, overlap: int) -> np.ndarray:
        """The numbers of the ``overlap`` nearest leaves of each vector, ascending."""
        own = x @ self.tops.T
        tops = np.argsort(-own, axis=1, kind="stable")[:, :overlap]
        if self.below is None:
            return np.sort(tops, axis=1)
        ids, sims = np.full((len(x), tops.shape[1] * overlap), -1), np.full((len(x), tops.shape[1] * overlap), -3.0)
        for rank in range(tops.shape[1]):
            for t in np.unique(tops[:, rank]):
                rows, (first, made) = np.flatnonzero(tops[:, rank] == t), self.below[t]
                cosine = x[rows] @ made.T
                best = np.argsort(-cosine, axis=1, kind="stable")[:, :overlap]
                at = rank * overlap + np.arange(best.shape[1])
                ids[rows[:, None], at], sims[rows[:, None], at] = first + best, np.take_along_axis(cosine, best, 1)
        return np.sort(np.take_along_axis(ids, np.argsort(-sims, axis=1, kind="stable")[:, :overlap], 1), axis=1)


def _trees(nodes: DataFrame, total: int) -> dict[tuple, Tree]:
    """By (label, length of vectors): the centroids of labels with more than one shard."""
    large = nodes.groupBy("label").agg(F.count("*").alias("c")).where(F.col("c") > SHARD).orderBy(F.desc("c"), "label").limit(MOST_LABELS).collect()
    wanted = {r["label"]: -(-r["c"] // SHARD) for r in large}
    whole = sum(wanted.values())
    scale = min(1.0, FLAT / max(1, whole))
    sampled = lambda most: nodes.where(F.pmod(F.xxhash64("node"), F.lit(max(1, -(-2 * total // most)))) == 0).limit(most)
    by_key: dict = {}
    for r in sorted(sampled(SAMPLE).select("label", "node", "v").collect(), key=lambda r: r["node"]):
        if r["label"] in wanted:
            by_key.setdefault((r["label"], len(r["v"])), []).append(r["v"])
    trees = {key: Tree(fit_centroids(unit(vs), max(1, int(wanted[key[0]] * scale) if whole > FLAT else wanted[key[0]]))) for key, vs in by_key.items()}
    if whole <= FLAT:
        return trees
    most = 4 * min(whole, MOST_CENTROIDS)
    number = {key: k for k, key in enumerate(trees)}
    rate = min(whole, MOST_CENTROIDS) / max(1, min(total, most // 2))  # leaves for each sampled vector
    share = dict.fromkeys(number.values(), rate)
    spread = nodes.sparkSession.sparkContext.broadcast((number, trees))

    @F.pandas_udf("struct<number:int,top:int>")
    def cell(labels: pd.Series, vectors: pd.Series) -> pd.DataFrame:
        number, trees = spread.value
        out = np.full((len(labels), 2), -1, dtype=np.int32)
        for key, at in _by_key(labels, vectors, number).items():
            out[at, 0], out[at, 1] = number[key], trees[key].nearest(unit(vectors.iloc[at]), 1)[:, 0]
        return pd.DataFrame(out, columns=["number", "top"])

    cells = sampled(most).select(cell("label", "v").alias("c"), "v").select("c.*", "v").where("number >= 0")
    made = {(r["number"], r["top"]): r["made"] for r in cells.groupBy("number", "top").applyInPandas(_fit_leaves(share), "number int, top int, made binary").collect()}
    for key, tree in trees.items():
        first, below = 0, []
        for t, centroid in enumerate(tree.tops):
            found = made.get((number[key], t))
            own = np.frombuffer(found, dtype=np.float32).reshape(-1, tree.tops.shape[1]) if found else centroid[None, :]
            below.append((first, own))
            first += len(own)
        tree.below = below
    spread.destroy()
    return trees


def _by_key(labels: pd.Series, vectors: pd.Series, known: dict) -> dict[tuple, list[int]]:
    rows: dict = {}
    for k, (label, v) in enumerate(zip(labels, vectors)):
        if (key := (label, len(v))) in known:
            rows.setdefault(key, []).append(k)
    return rows


def _shards(nodes: DataFrame, overlap: int, total: int) -> DataFrame:
    """``nodes`` with shards: array<int> of the nearest centroids' numbers in the label, ascending."""
    if not overlap:
        return nodes.withColumn("shards", F.array(F.lit(0)))
    trees = nodes.sparkSession.sparkContext.broadcast(_trees(nodes, total))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def nearest(labels: pd.Series, vectors: pd.Series) -> pd.Series:
        out: list = [[0]] * len(labels)
        for key, at in _by_key(labels, vectors, trees.value).items():
            for k, shards in zip(at, trees.value[key].nearest(unit(vectors.iloc[at]), overlap).tolist()):
                out[k] = shards
        return pd.Series(out)

    return nodes.withColumn("shards", nearest("label", "v"))


def _members(placed: DataFrame) -> DataFrame:
    """A row for each node and pair of blocks that its block is in."""
    width = F.size("v")
    spread = placed.select("label", "node", "n", "v", "shards", F.explode("shards").alias("shard")).withColumn("width", width)
    sizes = spread.groupBy("label", "width", "shard").agg(F.count("*").alias("c")).withColumn("blocks", F.ceil(F.col("c") / F.lit(BLOCK)).cast("int"))
    cutup = spread.join(sizes.drop("c"), ["label", "width", "shard"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = cutup.select("*", other)
    return pairs.select(
        "label", "width", "shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "v", "shards"
    )


def search_links(nodes: DataFrame, overlap: int, beam: int, threshold: float = THRESHOLD) -> DataFrame:
    """(node, links, pairs, root): what each group of nodes found; links, with copies, and pairs, without, are to be summed, roots connect nodes."""
    members = cut(_members(_shards(nodes, overlap, nodes.count())))
    group, kept = ["label", "width", *_GROUP[1:]], [members]
    if beam:
        edges = cut(members.select(*group, "node", "v").groupBy(*group).applyInPandas(_build_group, _EDGES))
        lists = edges.groupBy("node").agg(F.collect_set("next").alias("nexts"))
        members = members.join(lists, "node", "left")
        kept.append(edges)
    else:
        members = members.withColumn("nexts", F.array().cast("array<long>"))
    found = cut(members.groupBy(*group).applyInPandas(_search_group(beam, threshold), _FOUND))
    release(*kept)
    return found


def audit(nodes: DataFrame, found: DataFrame, threshold: float = THRESHOLD, queries: int = AUDITED) -> tuple[float, int]:
    """(recall, links seen) by brute force against all of up to ``queries`` nodes that have links, and as many of all nodes.

    Recall is the mean over the nodes that have links in truth, in the lesser of the two samples; links between equal vectors
    don't count. Without any link it is 1: then no node that was found to have one, and none of a sample of all, has one.
    """
    pairs = found.groupBy("node").agg(F.sum("pairs").alias("have"))
    known = nodes.join(pairs, "node", "left").select("label", "node", "v", F.coalesce("have", F.lit(0)).alias("have"))
    order = F.xxhash64("node", F.lit(7))
    samples = [known.where(c).orderBy(order).limit(queries).collect() for c in (F.col("have") > 0, F.lit(True))]
    asked = {r["node"]: r for sample in samples for r in sample}
    by: dict = {}
    for r in asked.values():
        by.setdefault((r["label"], len(r["v"])), []).append(r)
    tables = {k: (np.array([r["node"] for r in rows]), unit([r["v"] for r in rows])) for k, rows in by.items()}

    def run(batches):
        for pdf in batches:
            nodes_, there = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for key, at in _by_key(pdf["label"], pdf["v"], tables).items():
                ids, x = tables[key]
                near = (x @ unit(pdf["v"].iloc[at]).T >= threshold) & (ids[:, None] != pdf["node"].to_numpy()[at][None, :])
                nodes_.append(ids)
                there.append(near.sum(axis=1))
            yield pd.DataFrame({"node": np.concatenate(nodes_), "there": np.concatenate(there)})

    counted = nodes.select("label", "node", "v").mapInPandas(run, "node long, there long").groupBy("node").agg(F.sum("there").alias("there"))
    truth = {r["node"]: r["there"] for r in counted.collect()} if asked else {}
    recalls = [[min(1.0, r["have"] / truth[r["node"]]) for r in sample if truth.get(r["node"])] for sample in samples]
    return min((float(np.mean(r)) for r in recalls if r), default=1.0), sum(truth.values())


def near_duplicates(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(id, n_links, component, kept): one row for every row of ``table``."""
    rows = table.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), F.col(vector_column).alias("v"))
    rows = rows.withColumn("ok", usable(F.col("v"), F.col("label")) & F.col("id").isNotNull())
    same = F.struct("label", F.xxhash64("v").alias("a"), F.hash("v").alias("b"))
    hashed = rows.withColumn("h", F.when(F.col("ok"), same))
    keyed = cut(hashed.select("id", "ok", "h"))
    one = hashed.where("ok").groupBy("h").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.first("v").alias("v"))
    # Nodes have numbers of their own, since an id may be there twice.
    nodes = cut(one.select("h", "h.label", "first", "n", "v", F.monotonically_increasing_id().alias("node")))
    plain = nodes.select("label", "node", "n", "v")
    for overlap, beam in ROUNDS:
        found = search_links(plain, overlap * OVERLAP, beam * BEAM, threshold)
        if not beam or audit(plain, found, threshold)[0] >= recall:
            break
        release(found)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reach = components(found.where("node <> root").select("node", "root"))
    reached = nodes.join(links, "node", "left").join(reach, "node", "left")
    counted = cut(reached.select("h", "n", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("class")))
    named = counted.groupBy("class").agg(F.min("first").alias("component"), F.count("*").alias("size"))
    classes = cut(spread_join(counted, named, "class", "size", F.col("h")).select("h", "n", "n_links", "component"))
    release(nodes, found, counted)
    linked = spread_join(keyed.where("ok").select("id", "h"), classes, "h", "n", F.col("id")).select("id", "n_links", "component")
    alone = keyed.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.union(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component")))
