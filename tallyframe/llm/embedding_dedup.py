"""Near-duplicate embeddings by Euclidean p-stable hashing, checked by exact cosine.

Normalised vectors are projected onto Gaussian directions and quantised with a random offset; several
quantised projections together make one bucket number, in each of several tables. Vectors that share a
bucket are compared by cosine in double precision. A pair that shares several buckets is counted in its
first common table only, so nothing has to be deduplicated, and no pair ever leaves its bucket: a bucket
hands on link counts per vector and a forest of its links.

How many projections and tables there are follows from the number of vectors of the largest label: as
many projections as leave about ``CHANCE`` unrelated vectors beside each one in a bucket, and as many
tables as find a pair at the threshold with probability ``RECALL`` (closer pairs more often).

Equal vectors of a label are compared once, as a class with a count. A bucket too large for one task is
cut into chunks, and every pair of chunks becomes a task of its own.

Defined results: a vector that is null, empty or zero, or holds a null or non-finite component, or whose
label or id is null, links with nothing and is its own component. Vectors of different length don't
link. Repeated rows are vectors of their own, linked like any equal ones. An empty table gives an empty
result. Other columns of the input are ignored.
"""

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyframe.llm.common import components, forest, runs, staged

THRESHOLD = 0.93
RECALL = 0.997
CHANCE = 0.1
WIDTH = 2.0  # of a quantisation step
UNRELATED = math.sqrt(2)  # the distance of orthogonal unit vectors
CHUNK = 1024  # vectors of a bucket compared in one piece


def collision(distance, width=WIDTH):
    """Probability that one quantised projection agrees for two points at a distance."""
    r = width / distance
    tail = math.erfc(r / math.sqrt(2))  # both tails of the normal distribution beyond r
    return 1 - tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(vectors, threshold=THRESHOLD, recall=RECALL):
    """(projections, tables) for so many vectors of a label."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(UNRELATED)
    projections = max(4, math.ceil(math.log(max(vectors, 2) / CHANCE) / -math.log(far)))
    return projections, math.ceil(math.log(1 - recall) / math.log(1 - near**projections))


@lru_cache(16)
def _hashing(dims, projections, tables, seed):
    """Directions, offsets and multipliers; the same in every task."""
    rng = np.random.default_rng([seed, dims])
    directions = rng.standard_normal((dims, tables * projections))
    offsets = rng.uniform(0, WIDTH, tables * projections)
    return directions, offsets, rng.integers(1, 2**63, projections, dtype=np.uint64) | np.uint64(1)


def codes(vectors, projections, tables, seed=0):
    """Bucket numbers of normalised vectors: (vectors, tables)."""
    directions, offsets, multipliers = _hashing(vectors.shape[1], projections, tables, seed)
    steps = np.floor((vectors @ directions + offsets) / WIDTH).astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (steps.reshape(len(vectors), tables, projections) * multipliers).sum(2, dtype=np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def _matrix(column):
    """A list column of equally long vectors, normalised in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    vectors = flat.reshape(len(column), -1)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def _postings(classes, projections, tables, seed):
    """(class, table, bucket) for every class and table."""

    def post(batches):
        for batch in batches:
            lengths = batch.column("dims").to_numpy()
            for dims in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dims))
                found = codes(_matrix(part.column("vector")), projections, tables, seed)
                number = np.repeat(np.arange(tables), part.num_rows)
                column = lambda name: np.tile(part.column(name).to_numpy(), tables)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (column("cid"), column("space"), number, found.T.reshape(-1))],
                    ["cid", "space", "number", "code"],
                )

    rows = classes.select("cid", "space", "dims", "vector").mapInArrow(
        post, "cid long, space long, number long, code long"
    )
    return rows.select("cid", F.col("number").cast("int"), F.xxhash64("space", "number", "code").alias("bucket"))


def _compare(rows, projections, tables, threshold, seed):
    """Per bucket piece: link counts of its classes (other = null) and links of a forest (links = null)."""

    def compare(batches):
        for table, starts in runs(batches):
            cid, count, number, side = (table.column(c).to_numpy() for c in ("cid", "n", "number", "side"))
            space, dims = table.column("space").to_numpy(), table.column("dims").to_numpy()
            out = [[], [], []]
            # Buckets of two labels or tables may share a number by chance: each is compared for itself.
            kinds = np.stack([np.repeat(starts, np.diff(np.append(starts, len(cid)))), space, dims, number])
            if (kinds[:, 1:] != kinds[:, :-1]).any(0).sum() >= len(starts):
                order = np.lexsort((cid, number, dims, space, kinds[0]))
                table = table.take(pa.array(order))
                cid, count, number, side, space, dims = (x[order] for x in (cid, count, number, side, space, dims))
                kinds = kinds[:, order]
                starts = np.flatnonzero(np.concatenate([[True], (kinds[:, 1:] != kinds[:, :-1]).any(0)]))
            for a, b in zip(starts, np.append(starts[1:], len(cid))):
                if b - a < 2:
                    continue
                vectors = _matrix(table.column("vector").slice(a, b - a))
                found = codes(vectors, projections, tables, seed)
                low = side[a:b] == 0
                i = np.flatnonzero(low)
                j = np.flatnonzero(~low) if not low.all() else i
                x, y = np.nonzero(vectors[i] @ vectors[j].T >= threshold)
                x, y = i[x], j[y]
                keep = x < y if low.all() else np.ones(len(x), bool)
                t = int(number[a])
                keep &= found[x, t] == found[y, t]
                for earlier in range(t):
                    keep &= found[x, earlier] != found[y, earlier]
                x, y = x[keep], y[keep]
                if not len(x):
                    continue
                links = np.zeros(b - a, np.int64)
                np.add.at(links, x, count[a:b][y])
                np.add.at(links, y, count[a:b][x])
                own, linked, roots = cid[a:b], np.flatnonzero(links), forest(x, y, b - a)
                hung = np.flatnonzero(roots != np.arange(b - a))
                out[0] += [own[linked], own[hung]]
                out[1] += [np.full(len(linked), -1), own[roots[hung]]]
                out[2] += [links[linked], np.zeros(len(hung), np.int64)]
            columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cid", "other", "links"])

    return rows.mapInArrow(compare, "cid long, other long, links long")


def near_duplicates(embeddings, threshold=THRESHOLD, recall=RECALL, seed=0):
    """One row per vector: its links, the smallest id reachable by links, and whether that is its own."""
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    # Two hashes make a 128-bit key of label and vector.
    key = [F.xxhash64("label", "embedding").alias("_h1"), F.xxhash64("embedding", "label", F.lit(1)).alias("_h2")]
    rows = embeddings.select("vec_id", "label", "embedding").withColumn("_usable", F.coalesce(usable, F.lit(False)))
    members = rows.where("_usable").select("vec_id", "label", "embedding", *key)
    # Numbers given while a table is written stay as they are.
    classes = staged(
        members.groupBy("_h1", "_h2")
        .agg(
            F.min("vec_id").alias("first"), F.count("*").alias("n"),
            F.xxhash64(F.any_value("label")).alias("space"), F.any_value("embedding").alias("vector"),
        )
        .select("*", F.size("vector").cast("long").alias("dims"), F.monotonically_increasing_id().alias("cid")),
        "vector-classes",
    )
    most = classes.groupBy("space").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    projections, tables = parameters(most, threshold, recall)
    postings = staged(_postings(classes, projections, tables, seed), "vector-postings")
    shared = postings.groupBy(F.col("bucket").alias("_bucket")).agg(F.count("*").alias("_size")).where("_size > 1")
    chunks = F.ceil(F.col("_size") / CHUNK)
    pieces = postings.join(shared, F.col("bucket") == F.col("_bucket")).select(
        "cid", "number", "bucket", chunks.alias("_chunks"), F.pmod(F.xxhash64("cid", "bucket"), chunks).alias("_own")
    )
    # Each chunk meets itself and every other one once: side 0 is the lower chunk of a pair.
    pieces = pieces.select(
        "cid", "number", "bucket", "_own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)).alias("_met")
    ).select(
        F.xxhash64("bucket", F.least("_own", "_met"), F.greatest("_own", "_met")).alias("piece"), "cid", "number",
        (F.col("_own") > F.col("_met")).cast("int").alias("side"),
    )
    facts = classes.select(F.col("cid").alias("_cid"), "n", "space", "dims", "vector")
    pieces = pieces.join(facts, F.col("cid") == F.col("_cid")).drop("_cid")
    pieces = pieces.repartition("piece").sortWithinPartitions("piece", "cid")
    found = staged(_compare(pieces, projections, tables, threshold, seed), "vector-links")
    roots = components(found.where("other >= 0").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    links = found.where("other < 0").groupBy(F.col("cid").alias("_l")).agg(F.sum("links").alias("_links"))
    placed = classes.select("cid", "first", "n", "_h1", "_h2").join(
        roots.select(F.col("node").alias("_node"), "root"), F.col("cid") == F.col("_node"), "left"
    )
    placed = placed.join(links, F.col("cid") == F.col("_l"), "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = placed.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("_component"))
    placed = placed.join(smallest, F.col("root") == F.col("_root")).select(
        F.col("_h1").alias("_k1"), F.col("_h2").alias("_k2"), "_component",
        (F.col("n") - 1 + F.coalesce("_links", F.lit(0))).alias("_n_links"),
    )
    # Rows that link with nothing take no part in the join.
    linked = members.select("vec_id", "_h1", "_h2").join(
        placed, (F.col("_h1") == F.col("_k1")) & (F.col("_h2") == F.col("_k2"))
    )
    alone = rows.where("NOT _usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    out = linked.select("vec_id", F.col("_n_links").alias("n_links"), F.col("_component").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
