"""Approximate nearest neighbours by inner product: NN-descent graphs and greedy graph search.

Equal vectors are one node. Nodes are dealt to cells, each around one of a sample of vectors (its pivot), and a cell's nodes
to blocks of about ``BLOCK`` nodes, each with a neighbour graph of its own, so every task holds a bounded block.
NN-descent starts from random neighbours; in each round Spark joins every node's
neighbours (both directions) with their neighbours, and the candidates so found replace worse neighbours. Rounds stop when few
neighbours change. A query goes to the cells whose pivots are nearest to it, at least ``LEAST_CELLS`` of them and in
proportion to the square root of their number, so the work grows with the table to the power of 1.5 at most. It walks the graphs of
their blocks greedily: from entry nodes it goes on to the neighbours of the best nodes found,
as long as the best ``BEAM`` hold one that was not expanded. The entries of a block are so many that every node is one or
one link away from one, so clusters without links between them are all reached. Blocks' answers are merged by exact
scores in double precision.

A query's blocks, those of the nearest cells first, are visited in waves: the first ``FIRST_BLOCKS``, then up to ``WIDER`` times as many in all, and so on. A block's answers of a
later wave are only those that are no worse than the query's last one so far, so what waves return stays near the length of a list
however many blocks are visited, and the result is that of all blocks at once.

Cells are those of Euclidean distance after one component more has made all vectors equally long, which turns the largest inner
product into the least distance. Pivots are at most ``MOST_PIVOTS``, a bounded sample; every row is indexed. Of the reverse
neighbours beyond ``REVERSE``, each round takes others, by a hash that changes.

Edge cases: vectors that are null, zero, or hold a null or non-finite component take no part, neither as queries nor as
candidates; vectors of different lengths are never compared, and very long ones only make blocks heavier. Equal scores go to
the smaller id. Repeated rows are rows of their own, and so are rows that share an id but not the vector: each such query row
has a list of its own. Null ids take no part. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.scratch import release, written


BLOCK = 4_096
#: Nodes for each pivot, and the bound of the sample.
PER_CELL = 2_048
MOST_PIVOTS = 16_384
LEAST_CELLS = 16
#: Blocks of the first wave, and how many times as many the waves up to the next one visit.
FIRST_BLOCKS = 3
WIDER = 12
NEIGHBOURS = 14
REVERSE = 14
MOST_ROUNDS = 6
#: Rounds end when less than this share of neighbours was replaced.
SETTLED = 0.02
BEAM = 128
AT_ONCE = 16
QUERIES_TOGETHER = 512

_GRAPH = "block bigint, local int, near array<int>, n_new int"


def _usable(c: str):
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(c).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(c, lambda x: x != 0)


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64)


def first_neighbours(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Random neighbours within a block."""
    m = len(rows)
    rng = np.random.default_rng(abs(int(key[0])) % (1 << 32))
    k = min(NEIGHBOURS, m - 1)
    picks = rng.integers(1, m, (m, k)) if k else np.empty((m, 0), np.int64)
    near = (np.arange(m)[:, None] + picks) % m
    return pd.DataFrame({"block": key[0], "local": np.arange(m, dtype=np.int32), "near": list(near.astype(np.int32)), "n_new": np.int32(k)})


def better_neighbours(key: tuple, vectors: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
    """The best of each node's present and joined candidates."""
    vectors = vectors.sort_values("local")
    x = _stack(vectors["vector"])
    out, fresh = [], []
    for local, old, found in zip(candidates["local"], candidates["near"], candidates["found"]):
        pool = np.unique(np.concatenate([old, found]).astype(np.int64))
        pool = pool[pool != local]
        if len(pool) > NEIGHBOURS:
            pool = pool[np.argpartition(-(x[pool] @ x[local]), NEIGHBOURS - 1)[:NEIGHBOURS]]
        out.append(pool.astype(np.int32))
        fresh.append(len(np.setdiff1d(pool, old)))
    return pd.DataFrame({"block": key[0], "local": candidates["local"].astype(np.int32), "near": out, "n_new": np.array(fresh, np.int32)})


def entry_nodes(links: np.ndarray) -> np.ndarray:
    """Nodes from which one link leads to every other node; those with the most links are taken first."""
    reached = np.zeros(len(links), bool)
    entries = []
    for i in np.argsort((links == np.arange(len(links))[:, None]).sum(axis=1), kind="stable"):
        if not reached[i]:
            entries.append(i)
            reached[links[i]] = True
    return np.array(entries, np.int64)


def greedy_search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, own: np.ndarray, beam: int, k: int, entries: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, found) of the k best nodes that a greedy walk finds for each query; -1 where there are fewer.

    ``links`` has one row of neighbours for each node, padded by the node itself; ``own`` is the query's own node or -1;
    ``entries`` are those of ``entry_nodes``, if they are known.
    """
    m, q = len(x), len(queries)
    x32, q32 = x.astype(np.float32), queries.astype(np.float32)
    scores = np.full((q, m), -np.inf, np.float32)
    open_ = np.zeros((q, m), bool)
    rows = np.arange(q)[:, None]

    entries = entry_nodes(links) if entries is None else entries
    scores[:, entries] = q32 @ x32[entries].T
    open_[:, entries] = True
    at = np.flatnonzero(own >= 0)
    scores[at, own[at]] = np.einsum("qd,qd->q", q32[at], x32[own[at]])
    open_[at, own[at]] = True
    beam, width = min(beam, m), min(AT_ONCE, m)
    while True:
        bar = np.partition(scores, m - beam, axis=1)[:, m - beam]
        waiting = np.where(open_, scores, -np.inf)
        best = np.argpartition(-waiting, width - 1, axis=1)[:, :width]
        good = np.isfinite(waiting[rows, best]) & (waiting[rows, best] >= bar[:, None])
        live = np.flatnonzero(good.any(axis=1))
        if not len(live):
            break
        best, good = best[live], good[live]
        r, c = np.nonzero(good)
        open_[live[r], best[r, c]] = False
        # A node that is not expanded stands in by its query's best one, whose neighbours are then looked at twice.
        first = best[np.arange(len(live)), np.where(good, waiting[live[:, None], best], -np.inf).argmax(axis=1)]
        places = links[np.where(good, best, first[:, None])].reshape(len(live), -1)
        part = live[:, None]
        new = ~np.isfinite(scores[part, places])
        scores[part, places] = np.einsum("qd,qnd->qn", q32[live], x32[places])
        r, c = np.nonzero(new)
        open_[live[r], places[r, c]] = True
    # The margin leaves room for ties and for single precision; exact scores decide.
    keep = min(m, k + 8)
    places = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
    exact = np.einsum("qd,qnd->qn", queries, x[places])
    return np.where(np.isfinite(scores[rows, places]), places, -1), exact


class Router:
    """Finds the cell of a vector and the cells that a query visits, among the pivots of the vector's length."""

    def __init__(self, pivots: list[np.ndarray], longest: float):
        self.pivots: dict[int, np.ndarray] = {}
        for dim in {len(p) for p in pivots}:
            self.pivots[dim] = np.stack([p for p in pivots if len(p) == dim])
        self.rest = {dim: np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0)) for dim, x in self.pivots.items()}
        self.longest = longest

    def homes(self, vectors: list[np.ndarray]) -> np.ndarray:
        """The nearest pivot of each vector; 0 where none has its length."""
        out = np.zeros(len(vectors), np.int32)
        sizes = np.array([len(v) for v in vectors])
        for dim in set(sizes.tolist()) & set(self.pivots):
            for at in np.array_split(np.flatnonzero(sizes == dim), -(-int((sizes == dim).sum()) // 256)):
                x = np.stack([vectors[i] for i in at])
                rest = np.sqrt(np.maximum(self.longest**2 - (x**2).sum(axis=1), 0))
                out[at] = (x @ self.pivots[dim].T + rest[:, None] * self.rest[dim]).argmax(axis=1)
        return out

    def visits(self, vector: np.ndarray) -> list[int]:
        """The cells nearest to a query, nearest first."""
        if len(vector) not in self.pivots:
            return [0]
        scores = self.pivots[len(vector)] @ vector
        n = min(len(scores), max(LEAST_CELLS, int(np.ceil(4 * len(scores) ** 0.5))))
        near = np.argpartition(-scores, n - 1)[:n]
        return near[np.argsort(-scores[near], kind="stable")].astype(np.int32).tolist()


def _router(nodes: DataFrame, n: int, per_cell: int) -> Router:
    """Pivots are a uniform sample of nodes, of bounded size."""
    wanted = min(MOST_PIVOTS, -(-n // per_cell))
    longest = nodes.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    sample = nodes.orderBy(F.xxhash64("vector")).limit(wanted).select("vector").toPandas()["vector"]
    return Router([np.asarray(v, float) for v in sample], float(longest) ** 0.5)


def _searcher(k: int, beam: int):
    def search(key: tuple, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["query", "node", "least", "score"]
        if not len(index) or not len(queries):
            return pd.DataFrame({"query": np.empty(0, np.int64), "node": np.empty(0, np.int64), "least": np.empty(0, np.int64), "score": np.empty(0)})
        index = index.sort_values("local")
        x, nodes, least = _stack(index["vector"]), index["node"].to_numpy(np.int64), index["least"].to_numpy(np.int64)
        m = len(x)
        width = max(1, max(map(len, index["links"])))
        links = np.repeat(np.arange(m)[:, None], width, axis=1)
        for i, near in enumerate(index["links"]):
            links[i, : len(near)] = near
        entries = entry_nodes(links)
        place = {int(n): i for i, n in enumerate(nodes)}
        parts = []
        for at in range(0, len(queries), QUERIES_TOGETHER):
            part = queries.iloc[at : at + QUERIES_TOGETHER]
            ids = part["query"].to_numpy(np.int64)
            own = np.array([place.get(int(i), -1) for i in ids])
            places, exact = greedy_search(x, links, _stack(part["vector"]), own, beam, k, entries)
            good = places >= 0
            order = np.lexsort((least[places], np.where(good, -exact, np.inf)), axis=1)[:, :k]
            r = np.repeat(np.arange(len(ids)), order.shape[1])
            c = order.ravel()
            # What is worse than the list so far can't be in it.
            good = good[r, c] & (exact[r, c] >= part["bar"].to_numpy(float)[r])
            at_node = places[r, c]
            parts.append(pd.DataFrame({"query": ids[r], "node": nodes[at_node], "least": least[at_node], "score": exact[r, c]})[good])
        return pd.concat(parts)[columns]

    return search


def build_graph(nodes: DataFrame) -> DataFrame:
    """(block, local, links) from (block, local, vector): NN-descent through joins, then links in both directions."""
    graph = written(nodes.select("block", "local").groupBy("block").applyInPandas(first_neighbours, _GRAPH), "graph")
    for turn in range(MOST_ROUNDS):
        both = _both_ways(graph, turn)
        links = both.groupBy("block", "local").agg(F.collect_list("other").alias("links"))
        # Neighbours of neighbours: each node's links meet the links of the nodes they lead to.
        met = both.join(links.select("block", F.col("local").alias("other"), F.col("links").alias("theirs")), ["block", "other"])
        found = met.groupBy("block", "local").agg(F.array_distinct(F.flatten(F.collect_list("theirs"))).alias("found"))
        candidates = graph.select("block", "local", "near").join(found, ["block", "local"], "left").withColumn("found", F.coalesce("found", F.expr("cast(array() as array<int>)")))
        vectors = nodes.select("block", "local", "vector")
        better = written(vectors.groupBy("block").cogroup(candidates.groupBy("block")).applyInPandas(better_neighbours, _GRAPH), "graph")
        release(graph)
        graph = better
        moved = graph.agg(F.sum("n_new").alias("new"), F.sum(F.size("near")).alias("all")).first()
        if (moved["new"] or 0) <= SETTLED * (moved["all"] or 0):
            break
    both = _both_ways(graph, MOST_ROUNDS, 2 * REVERSE)
    return both.groupBy("block", "local").agg(F.collect_set("other").alias("links"))


def _both_ways(graph: DataFrame, turn: int, most: int = REVERSE) -> DataFrame:
    """(block, local, other): links and reverse links, of the latter a turn's choice where a node has very many."""
    there = graph.select("block", "local", F.explode("near").alias("other"))
    back = there.select("block", F.col("other").alias("local"), F.col("local").alias("other"))
    rank = F.row_number().over(Window.partitionBy("block", "local").orderBy(F.xxhash64(F.lit(turn), "other")))
    return there.unionByName(back.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")).distinct()


def nearest(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, beam: int = BEAM, block: int = BLOCK, per_cell: int = PER_CELL) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by ``every``, the k rows of largest inner product."""
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_column}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    rows = written(rows.filter(F.col("vec_id").isNotNull() & _usable("vector")).groupBy("vec_id", "vector").agg(F.count("*").alias("times")), "ann-rows")
    # Partial aggregation folds equal vectors before the shuffle, however many there are. Written numbers stay as they are.
    nodes = rows.groupBy("vector").agg(F.min("vec_id").alias("least")).withColumn("node", F.monotonically_increasing_id())
    keys = written(nodes, "ann-nodes")
    n = keys.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    router = _router(keys, n, per_cell)

    @F.pandas_udf("int")
    def home(vectors: pd.Series) -> pd.Series:
        return pd.Series(router.homes(vectors.to_list()))

    @F.pandas_udf("array<int>")
    def visits(vectors: pd.Series) -> pd.Series:
        return vectors.map(router.visits)

    celled = written(keys.withColumns({"dim": F.size("vector"), "cell": home("vector")}), "ann-celled")
    release(keys)
    # One row for each pivot at most; a cell of more than a block's nodes is dealt to several blocks.
    cells = written(celled.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).alias("blocks")), "ann-cells")
    name = lambda part: F.xxhash64("dim", "cell", part).alias("block")
    dealt = celled.join(cells, ["dim", "cell"]).select("node", "least", "vector", "dim", name(F.pmod(F.xxhash64("node"), "blocks")))
    placed = dealt.withColumn("local", (F.row_number().over(Window.partitionBy("block").orderBy("node")) - 1).cast("int"))
    placed = written(placed, "ann-placed")
    graph = written(build_graph(placed), "ann-links")
    none = F.expr("cast(array() as array<int>)")
    index = placed.join(graph, ["block", "local"], "left").select("block", "local", "node", "least", "vector", F.coalesce("links", none).alias("links"))
    # Members of a node in order of id: k + 1 suffice, as ties go to the smaller id and only the query's own row is left out.
    named = rows.join(placed.select("node", F.col("vector").alias("v")), F.col("vector") == F.col("v")).select("vec_id", "node", "times")
    own = written(named.filter(F.col("vec_id") % every == 0), "ann-queries")
    asked = celled.join(own.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("query"), "vector", "dim", F.posexplode(visits("vector")).alias("at", "cell"))
    asked = asked.join(cells, ["dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    turn = F.row_number().over(Window.partitionBy("query").orderBy("at", "part")) - 1
    asked = written(asked.select("query", "vector", turn.alias("at"), name(F.col("part"))), "ann-asked")
    release(celled)
    most = asked.agg(F.max("at")).first()[0]
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    found, start, end = None, 0, FIRST_BLOCKS
    while found is None or (most is not None and start <= most):
        wave = asked.filter((F.col("at") >= start) & (F.col("at") < end)).select("block", "query", "vector")
        bars = None if found is None else found.groupBy("query").agg(F.when(F.count("*") > k, F.min("score")).alias("bar"))
        wave = wave.withColumn("bar", F.lit(None).cast("double")) if bars is None else wave.join(bars, "query", "left")
        wave = written(wave.withColumn("bar", F.coalesce("bar", F.lit(float("-inf")))), "ann-wave")
        # Blocks that very many queries visit are searched by several tasks.
        chunks = written(wave.groupBy("block").agg(F.ceil(F.count("*") / (4 * QUERIES_TOGETHER)).alias("chunks")), "ann-chunks")
        dealt = wave.join(chunks, "block").select("block", F.pmod(F.xxhash64("query"), "chunks").alias("chunk"), "query", "vector", "bar")
        spread = index.join(chunks, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))).drop("chunks")
        more = spread.groupBy("block", "chunk").cogroup(dealt.groupBy("block", "chunk")).applyInPandas(_searcher(k + 1, beam), "query bigint, node bigint, least bigint, score double")
        more = more if found is None else more.unionByName(found)
        more = written(more.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r"), "ann-found")
        for used in (wave, chunks, found):
            release(used)
        found, start, end = more, end, end * WIDER
    first = Window.partitionBy("node").orderBy("vec_id")
    members = named.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).select("node", "vec_id", "times")
    members = written(members.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k + 1)).cast("int")))).drop("times"), "ann-members")
    lists = found.join(members, "node").select("query", "node", "vec_id", "copy", "score")
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "node", "copy")
    lists = lists.withColumn("r", F.row_number().over(ranked)).filter(F.col("r") <= k + 1)
    lists = written(lists.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "node", "vec_id", "copy", "score"))).alias("list")), "ann-lists")
    for used in (placed, graph, cells, asked):
        release(used)
    # A query row leaves out itself; repeated query rows give repeated answers.
    hits = own.join(lists, F.col("node") == F.col("query")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    hits = hits.select(F.col("vec_id").alias("query_id"), F.expr("filter(list, x -> not (x.node = node and x.vec_id = vec_id and x.copy = 1))").alias("list"))
    out = hits.select("query_id", F.posexplode(F.slice("list", 1, k)))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))
