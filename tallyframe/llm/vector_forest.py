"""Approximate nearest neighbours: a forest of random-projection trees, searched best first.

Every tree halves the vectors level by level at the median of a random projection. Directions are drawn from
a bounded sample of the vectors, ``SAMPLE`` rows, so that they follow the data's spread; medians are the
sample's as well, and every vector is indexed in every tree. A query walks all trees through one priority
queue: a branch not taken costs the squared distance to its border, and the cheapest branch of any tree is
opened next. The leaves it opens are its candidates, which are compared exactly, on the original vectors.

How many leaves a query opens is measured, not fixed: for ``TRIALS`` queries the true neighbours are found
among all vectors, and the number is such that ``RECALL`` of these neighbours lie in opened leaves. Data without
structure take many leaves that way, clustered data few. Leaves grow with the table where it has more than
``LEAF / SAMPLE_LEAF`` times ``SAMPLE`` vectors.

Neighbouring leaves of a tree form a piece; a query is sent to a piece once, with the leaves it opens there,
and takes away its nearest candidates alone. A piece of too many vectors is cut into chunks by hash. Equal
vectors are one class with its least ids, as many as could be asked for, so that a vector repeated in any number
of rows is compared once.

Defined results: ids that are null, and vectors that are null, empty or zero or hold null or non-finite
components, take no part. Where lengths differ, shorter vectors count as filled up with zeros. Rows that repeat id
and vector are one candidate; of an id with several vectors the nearest counts. A query's own id is no
candidate of its. Ties go to the smaller id. Fewer candidates than asked for are all returned. An empty table gives
an empty result. Other columns are ignored.
"""

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.llm.common import ship, staged

NEIGHBOURS = 10
EVERY = 100  # ids divisible by this are queries
TREES = 4
LEAF = 64  # vectors of a leaf, on average
SAMPLE = 32_768
SAMPLE_LEAF = 16  # sampled vectors of a leaf, at least
PIECE = 4096  # vectors of neighbouring leaves searched together
TRIALS = 64
RECALL = 0.97  # of the trials' neighbours
BLOCK = 256  # queries compared at a time


def matrix(column, dims):
    """A list column as a matrix in double precision, shorter lists filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == len(column) * dims:
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims))
    lengths = np.asarray([len(x) for x in column])
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


class Forest:
    """Trees of one depth: a direction for each level of each tree, a median for each node."""

    def __init__(self, sample, vectors, trees=TREES, leaf=LEAF, seed=0):
        rng = np.random.default_rng(seed)
        fitting = math.log2(max(1, len(sample) / SAMPLE_LEAF))
        self.trees, self.depth = trees, max(0, math.floor(min(math.log2(max(1, vectors / leaf)), fitting)))
        count = trees * self.depth
        # Random sums of the sample's vectors vary along the axes as the vectors do.
        self.directions = np.zeros((count, sample.shape[1]))
        if count:
            self.directions = rng.standard_normal((count, len(sample))) @ (sample - sample.mean(0))
            self.directions /= np.maximum(np.linalg.norm(self.directions, axis=1, keepdims=True), 1e-300)
        self.medians = np.zeros((trees, 2**self.depth))
        projected = self.project(sample)
        for tree in range(trees):
            node = np.ones(len(sample), np.int64)
            for level in range(self.depth):
                at = projected[:, tree * self.depth + level]
                order = np.lexsort((at, node))
                nodes, begin, size = np.unique(node[order], return_index=True, return_counts=True)
                self.medians[tree, nodes] = at[order][begin + size // 2]
                node = 2 * node + (at >= self.medians[tree, node])

    def project(self, vectors):
        return vectors @ self.directions.T

    def leaves(self, vectors):
        """The leaf of every vector in every tree: (vectors, trees)."""
        projected, out = self.project(vectors), np.zeros((len(vectors), self.trees), np.int64)
        for tree in range(self.trees):
            node = np.ones(len(vectors), np.int64)
            for level in range(self.depth):
                node = 2 * node + (projected[:, tree * self.depth + level] >= self.medians[tree, node])
            out[:, tree] = node - 2**self.depth
        return out

    def search(self, projected):
        """(tree, leaf) from the nearest on, for one projected query: the queue is shared by all trees."""
        queue = [(0.0, tree, 1, 0) for tree in range(self.trees)]
        medians, depth = self.medians, self.depth
        while queue:
            cost, tree, node, level = heapq.heappop(queue)
            while level < depth:
                over = projected[tree * depth + level] - medians[tree, node]
                node, level = 2 * node + (over >= 0), level + 1
                heapq.heappush(queue, (cost + over * over, tree, node ^ 1, level))
            yield tree, int(node) - 2**depth


def distances(query, vectors):
    """Euclidean distances in double precision, by differences."""
    away = vectors - query
    return np.sqrt((away * away).sum(1))


def _usable(rows, name):
    vector = F.col("embedding")
    usable = F.col(name).isNotNull() & vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists(vector, lambda x: x != 0)
    # Two hashes make a 128-bit key of a vector; minus zero is zero.
    vector = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0).cast("double")).otherwise(x.cast("double")))
    rows = rows.where(usable).select(F.col(name).alias("id"), "embedding", vector.alias("_vector"))
    return rows.select(
        "id", "embedding", F.xxhash64("_vector").alias("h1"), F.xxhash64("_vector", F.lit(1)).alias("h2")
    )


def _routed(classes, dims, forest):
    """The classes with their leaf in every tree."""

    def route(batches):
        for batch in batches:
            leaves = forest.leaves(matrix(batch.column("vector"), dims))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(leaves) + 1) * forest.trees, pa.int32()), pa.array(leaves.reshape(-1))
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "leaves"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(route, f"{kinds}, leaves array<bigint>")


def _nearest(found, by, k):
    """The ``k`` nearest rows of ``found`` (..., score, first) for each value of ``by``."""
    order = Window.partitionBy(*by).orderBy("score", "first")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _true_neighbours(classes, dims, vectors, k):
    """The exact ``k`` nearest classes of a few vectors, themselves left out: (trial, leaves) rows."""

    def compare(batches):
        best = [(np.zeros(0), np.zeros(0, np.int64), []) for _ in vectors]
        for batch in batches:
            if not batch.num_rows or not len(vectors):
                continue
            rows, first = matrix(batch.column("vector"), dims), batch.column("first").to_numpy()
            leaves = batch.column("leaves").to_pylist()
            rough = (rows * rows).sum(1) - 2 * (vectors @ rows.T)
            some = min(k + 1, len(rows))
            for trial, near in enumerate(np.argpartition(rough, some - 1, axis=1)[:, :some]):
                score = distances(vectors[trial], rows[near])
                near, score = near[score > 0], score[score > 0]
                known = best[trial]
                score, ids = np.concatenate([known[0], score]), np.concatenate([known[1], first[near]])
                paths = known[2] + [leaves[i] for i in near]
                order = np.lexsort((ids, score))[:k]
                best[trial] = score[order], ids[order], [paths[i] for i in order]
        for trial, (score, ids, paths) in enumerate(best):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(score), trial)), pa.array(score), pa.array(ids, pa.int64()),
                 pa.array(paths, pa.list_(pa.int64()))],
                ["trial", "score", "first", "leaves"],
            )

    found = classes.select("vector", "first", "leaves").mapInArrow(
        compare, "trial long, score double, first long, leaves array<bigint>"
    )
    return _nearest(found, ["trial"], k).select("trial", "leaves").collect()


def leaves_to_open(forest, vectors, neighbours, recall=RECALL):
    """How many leaves a query has to open so that ``recall`` of the neighbours known lie in them.

    ``neighbours`` are (number of the vector, leaves of a neighbour in every tree).
    """
    wanted = {}
    for trial, leaves in neighbours:
        wanted.setdefault(trial, []).append(set(enumerate(leaves)))
    needed = []
    for trial, paths in wanted.items():
        found = forest.search(forest.project(vectors[trial]))
        for opened, place in enumerate(found, 1):
            met = [p for p in paths if place in p]
            needed += [opened] * len(met)
            paths = [p for p in paths if place not in p]
            if not paths:
                break
    needed.sort()
    return needed[math.ceil(recall * len(needed)) - 1] if needed else 1


def _probes(queries, dims, forest, opened, candidates, sizes, shift, chunks):
    """(piece, side 1, query key, vector, leaves there): a row for every piece chunk a query looks into."""

    def search(batches):
        for batch in batches:
            projected = forest.project(matrix(batch.column("vector"), dims))
            rows, pieces, lists = [], [], []
            for i, at in enumerate(projected):
                places, met = {}, 0
                for n, (tree, leaf) in enumerate(forest.search(at), 1):
                    places.setdefault((tree, leaf >> shift), []).append(leaf)
                    met += sizes[tree][leaf]
                    if n >= opened and met >= candidates:
                        break
                for (tree, part), leaves in places.items():
                    for chunk in range(chunks[tree][part]):
                        rows.append(i)
                        pieces.append((tree << 40) + (part << 20) + chunk)
                        lists.append(leaves)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pieces, pa.int64()), pa.array(np.ones(len(rows), np.int32)),
                 *(batch.column(c).take(pa.array(rows, pa.int64())) for c in ("h1", "h2", "vector")),
                 pa.array(lists, pa.list_(pa.int64()))],
                ["piece", "side", "h1", "h2", "vector", "leaves"],
            )

    kind = queries.schema["vector"].dataType.simpleString()
    return queries.select("h1", "h2", "vector").mapInArrow(
        search, f"piece long, side int, h1 long, h2 long, vector {kind}, leaves array<bigint>"
    )


class _Piece:
    """The vectors of a piece, by leaf."""

    def __init__(self, tables, dims, k):
        table = pa.Table.from_batches(tables)
        leaf = table.column("leaves").combine_chunks().flatten().to_numpy()
        order = np.argsort(leaf, kind="stable")
        self.vectors = matrix(table.column("vector"), dims)[order]
        self.cid, self.first = (table.column(c).to_numpy()[order] for c in ("cid", "first"))
        leaves, begin = np.unique(leaf[order], return_index=True)
        ends = np.append(begin[1:], len(order))
        self.ranges = {x: (a, b) for x, a, b in zip(leaves.tolist(), begin.tolist(), ends.tolist())}
        self.norms, self.k = (self.vectors * self.vectors).sum(1), k

    def nearest(self, queries, leaves):
        """(query, row, score) of the nearest vectors in the leaves that each query opens."""
        away = np.full((len(queries), len(self.vectors)), np.inf)
        by_leaf = {}
        for i, opened in enumerate(leaves):
            for leaf in opened:
                by_leaf.setdefault(leaf, []).append(i)
        for leaf, who in by_leaf.items():
            if leaf in self.ranges:
                a, b = self.ranges[leaf]
                away[who, a:b] = self.norms[a:b] - 2 * (queries[who] @ self.vectors[a:b].T)
        # A few more than asked for, as these figures are rounded; then the exact measure.
        some = min(2 * self.k + 8, away.shape[1])
        near = np.argpartition(away, some - 1, axis=1)[:, :some]
        for i, rows in enumerate(near):
            rows = rows[np.isfinite(away[i, rows])]
            score = distances(queries[i], self.vectors[rows])
            order = np.lexsort((self.first[rows], score))[: self.k]
            yield i, rows[order], score[order]


def _compare(rows, dims, k):
    """Per piece and query the ``k`` nearest classes: (h1, h2, cid, first, score)."""

    def results(piece, part):
        out = [[], [], [], [], []]
        h1, h2 = part.column("h1").to_numpy(), part.column("h2").to_numpy()
        vectors, leaves = matrix(part.column("vector"), dims), part.column("leaves").to_pylist()
        for at in range(0, len(h1), BLOCK):
            for i, near, score in piece.nearest(vectors[at : at + BLOCK], leaves[at : at + BLOCK]):
                own = np.full(len(near), h1[at + i]), np.full(len(near), h2[at + i])
                for column, values in zip(out, (*own, piece.cid[near], piece.first[near], score)):
                    column.append(values)
        arrays = [np.concatenate(c) if c else np.zeros(0) for c in out]
        kinds = [*[pa.int64()] * 4, pa.float64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(a.astype(t.to_pandas_dtype()), t) for a, t in zip(arrays, kinds)], ["h1", "h2", "cid", "first", "score"]
        )

    def compare(batches):
        number, gathered, piece = None, [], None
        for batch in batches:
            # Sorted: a piece's vectors come first, its queries follow.
            key = np.stack([batch.column("piece").to_numpy(), batch.column("side").to_numpy()])
            starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])) if batch.num_rows else []
            for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
                if key[0, a] != number:
                    number, gathered, piece = key[0, a], [], None
                if key[1, a] == 0:
                    gathered.append(batch.slice(a, b - a))
                elif gathered:
                    piece = piece or _Piece(gathered, dims, k)
                    yield results(piece, batch.slice(a, b - a))

    return rows.mapInArrow(compare, "h1 long, h2 long, cid long, first long, score double")


def nearest(queries, candidates, k=NEIGHBOURS, trees=TREES, recall=RECALL, seed=0):
    """(query_id, rank, vec_id, score): for ``queries`` (query_id, embedding) the nearest of ``candidates`` (vec_id, embedding)."""
    spark = candidates.sparkSession
    ship(spark)
    members = staged(_usable(candidates, "vec_id").withColumnRenamed("id", "vec_id"), "forest-vectors")
    classes = staged(
        members.groupBy("h1", "h2")
        .agg(F.any_value("embedding").alias("vector"), F.min("vec_id").alias("first"))
        .select("*", F.monotonically_increasing_id().alias("cid")),
        "forest-classes",
    )
    count, dims = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
    asked = _usable(queries, "query_id").withColumnRenamed("id", "query_id")
    dims = max(dims or 1, asked.agg(F.max(F.size("embedding"))).first()[0] or 1)
    # By hash, so about as many rows as asked for; twice as many never.
    share = F.pmod("h1", F.lit(2**40)) < int(2**40 * min(1.0, SAMPLE / max(count, 1)))
    sample = matrix(classes.where(share).limit(2 * SAMPLE).select("vector").toArrow().column("vector"), dims)
    sample = sample[np.lexsort(sample.T[::-1])]  # in an order that does not depend on partitions
    forest = Forest(sample, count, trees, LEAF, seed)

    classes = staged(_routed(classes, dims, forest), "forest-leaves")
    counted = classes.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count()
    sizes = np.zeros((trees, 2**forest.depth), np.int64)
    for tree, leaf, n in counted.collect():  # bounded by the forest
        sizes[tree, leaf] = n
    trials = sample[np.random.default_rng(seed).permutation(len(sample))[:TRIALS]]
    known = [(r.trial, r.leaves) for r in _true_neighbours(classes, dims, trials, k)] if forest.depth else []
    opened = leaves_to_open(forest, trials, known, recall)
    # Whatever the leaves, a query meets as many different classes as it may need.
    candidates_met = trees * (k + 2)

    shift = max(0, math.floor(math.log2(max(1.0, PIECE / max(1.0, count / 2**forest.depth)))))
    shift = min(shift, forest.depth)
    chunks = np.ceil(sizes.reshape(trees, -1, 2**shift).sum(2) / (2 * PIECE)).astype(np.int64).tolist()
    sizes = sizes.tolist()

    cut = F.array(*[F.array(*[F.lit(n) for n in tree]) for tree in chunks])
    rows = classes.select("cid", "first", "vector", F.posexplode("leaves").alias("tree", "leaf")).withColumn(
        "part", F.shiftright("leaf", shift)
    )
    chunk = F.pmod(F.xxhash64("cid"), F.get(F.get(cut, F.col("tree")), F.col("part").cast("int")))
    rows = rows.select(
        (F.shiftleft(F.col("tree").cast("long"), 40) + F.shiftleft("part", 20) + chunk).alias("piece"), F.lit(0).alias("side"),
        "cid", "first", "vector", F.array("leaf").alias("leaves"),
    )
    asked = asked.select("query_id", "h1", "h2", "embedding")
    classes_asked = asked.groupBy("h1", "h2").agg(F.any_value("embedding").alias("vector"))
    probes = _probes(classes_asked, dims, forest, opened, candidates_met, sizes, shift, chunks)
    met = rows.unionByName(probes, allowMissingColumns=True)
    met = met.repartition("piece").sortWithinPartitions("piece", "side")
    found = _compare(met, dims, k + 1).groupBy("h1", "h2", "cid").agg(F.min("score").alias("score"), F.min("first").alias("first"))
    found = staged(_nearest(found, ["h1", "h2"], k + 1).drop("rank"), "forest-found")

    # A class stands for its least ids, one more than asked for.
    ids = members.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "vec_id").distinct()
    ids = ids.withColumn("_n", F.row_number().over(Window.partitionBy("c1", "c2").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    named = classes.select(F.col("cid").alias("_cid"), F.col("h1").alias("c1"), F.col("h2").alias("c2"))
    answers = found.join(named, F.col("cid") == F.col("_cid")).join(ids, ["c1", "c2"])
    answers = _nearest(answers.select("h1", "h2", "score", F.col("vec_id").alias("first")), ["h1", "h2"], k + 1)
    answers = answers.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), "score", F.col("first").alias("vec_id"))
    pairs = asked.select("query_id", "h1", "h2").distinct().join(
        answers, (F.col("h1") == F.col("a1")) & (F.col("h2") == F.col("a2"))
    )
    pairs = pairs.where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return _nearest(pairs.withColumnRenamed("vec_id", "first"), ["query_id"], k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("first").alias("vec_id"), "score"
    )


def nearest_of_every(embeddings, every=EVERY, k=NEIGHBOURS):
    """The nearest neighbours of the rows whose id is divisible by ``every``, among all rows."""
    queries = embeddings.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return nearest(queries, embeddings.select("vec_id", "embedding"), k)
