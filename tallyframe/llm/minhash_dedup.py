"""Near-duplicate texts by an inverted join over MinHash signature coordinates, confirmed on full sets.

A text's set holds the distinct runs of ``words`` consecutive words, A-Z in lower case; a text with fewer
words is one run. Texts with equal sets are one class and are handled once. Two sets agree in each
coordinate of their signatures with the probability of their similarity, so a similar pair agrees in at
least ``MATCHES`` of ``COORDINATES`` nearly always.

Join. Classes are posted under (coordinate, value). Prefix: of so many matches one lies among the first
``COORDINATES - MATCHES + 1`` coordinates, and only these are posted. A pair is counted in the list of its
first match alone; there all its matches are counted. Skips: lists of one class, lists whose classes are
linked already, and pairs whose set sizes differ too much are passed over. A list longer than ``LONG_LIST``
is not merged but posted again under each classes' next possible match, up to ``DEPTH`` times; what is
still long is cut into chunks, every two of which are merged in a task of their own.

Copies first: classes that share a run of ``BAND`` coordinates are confirmed against the smallest of them,
which links large groups of near copies without pairing them all. After that only pairs of classes that
are not linked yet are sought, so the confirmed links connect exactly what all links would connect.

Nowhere are the pairs of a group written out. A list hands on a forest of its matching pairs; the classes
that such forests and known links connect form a group, and the sets of a group are compared inside tasks,
one for every two chunks of ``GROUP_CHUNK`` classes, which again hand on a forest of confirmed links.

Defined results: a text that is null or has no words has an empty set and links with nothing, nor does a
row without id; such rows are kept, each in a component of its own id. Repeated rows are in one class.
Rows that repeat an id with other texts share one component entry per text. An empty table gives an empty
result. Other columns of the input are ignored by ``near_duplicates``; ``drop_near_duplicates`` keeps them.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyframe.llm.common import components, forest, give_back, runs, slices, staged, utf8

WORDS = 2
PERCENT = 80
COORDINATES, MATCHES = 24, 11  # a pair of similarity 0.8 has fewer matches once in 50,000 times
PREFIX = COORDINATES - MATCHES + 1
BAND = 4
LONG_LIST = 4096
DEPTH = 3
CHUNK = 4096
HUB_ROWS = 2000  # texts confirmed against one in a task
GROUP_CHUNK = 512
STEP_BYTES = 1 << 19
PAIRS = 1 << 20  # compared at a time

_RANDOM = np.random.default_rng(6)
BASE = int(_RANDOM.integers(1, 2**63)) | 1
TIMES = _RANDOM.integers(1, 2**63, COORDINATES, dtype=np.uint64)[:, None] | np.uint64(1)
PLUS = _RANDOM.integers(1, 2**63, COORDINATES, dtype=np.uint64)[:, None]
STEP = np.uint64(int(_RANDOM.integers(1, 2**63)) | 1)
LETTER = np.arange(256, dtype=np.uint8)
LETTER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def _mixed(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base, n, known={}):
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    if base not in known or len(known[base]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        known[base] = np.cumprod(np.full(size, base, np.uint64)) * np.uint64(pow(base, -1, 1 << 64))
    return known[base][:n]


def shingles(texts, words=WORDS):
    """Sorted distinct 64-bit numbers of each text's runs of words, for a list of UTF-8 texts or None.

    A word's number is the difference of two prefix sums over all the texts' bytes.
    """
    texts = [t or b"" for t in texts]
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    space = SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=1, append=1)
    starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((LETTER[data] + np.uint64(1)) * _powers(BASE, len(data)))])
    number = (sums[stops] - sums[starts]) * _powers(pow(BASE, -1, 1 << 64), len(data))[starts]
    number = _mixed(number + (stops - starts).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    bounds = [0, *np.searchsorted(starts, ends).tolist()]
    joined = number
    for _ in range(words - 1):
        joined = joined[:-1] * STEP + number[-len(joined) + 1 :] if len(joined) > 1 else joined[:0]
    joined = _mixed(joined)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= words:
            found = np.sort(joined[a : b - words + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif b > a:
            short = np.uint64(b - a)
            for x in number[a:b]:
                short = short * STEP + x
            out.append(_mixed(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _facts(found):
    """(size, two sums that tell sets apart, signature bytes) of a set."""
    if not len(found):
        return 0, 0, 0, b""
    signature = ((found * TIMES + PLUS) >> np.uint64(32)).min(1).astype(np.uint32)
    second = np.bitwise_xor.reduce(_mixed(found + np.uint64(1)))
    signed = lambda x: int(np.uint64(x).view(np.int64))
    return len(found), signed(found.sum(dtype=np.uint64)), signed(second), signature.tobytes()


def signatures(docs, words=WORDS):
    """(doc_id, text_hash, n, h1, h2, signature) for every row; equal sets have equal (n, h1, h2)."""
    kind = dict(docs.dtypes)["doc_id"]

    def sign(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                a = 0
                for part in slices(batch.column(1), STEP_BYTES):
                    b = a + len(part)
                    rows = list(zip(*map(_facts, shingles(utf8(part), words))))
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    columns = [pa.array(c, t) for c, t in zip(rows, types)]
                    given = [batch.column(i).slice(a, b - a) for i in (0, 2)]
                    yield pa.RecordBatch.from_arrays(
                        [*given, *columns], ["doc_id", "text_hash", "n", "h1", "h2", "signature"]
                    )
                    a = b
        give_back()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        sign, f"doc_id {kind}, text_hash long, n long, h1 long, h2 long, signature binary"
    )


def _exact(text, words):
    """The set itself."""
    parts = (text or b"").translate(bytes(LETTER)).split()
    if len(parts) < words:
        return {b" ".join(parts)} if parts else set()
    return set(map(b" ".join, zip(*(parts[i:] for i in range(words)))))


def confirm(pairs, classes, docs, words=WORDS, percent=PERCENT):
    """The pairs (a, b) of class numbers whose sets are similar enough, checked on the texts themselves.

    A task reads one text, then up to ``HUB_ROWS`` texts to compare with it, one at a time.
    """
    sizes = pairs.groupBy(F.col("a").alias("_a")).agg(F.ceil(F.count("*") / HUB_ROWS).alias("_parts"))
    pairs = pairs.join(sizes, F.col("a") == F.col("_a")).select(
        "a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("_parts"))).alias("hub")
    )
    rows = pairs.select("hub", "a", F.col("b").alias("own"), F.lit(1).alias("role")).unionByName(
        pairs.select("hub", "a", F.col("a").alias("own"), F.lit(0).alias("role")).distinct()
    )
    facts = classes.select(F.col("cid").alias("_cid"), "first", "n", "h1", "h2")
    rows = rows.join(facts, F.col("own") == F.col("_cid")).drop("_cid")
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
    rows = rows.join(texts, F.col("first") == F.col("_doc")).select("hub", "role", "a", "own", "n", "h1", "h2", "_text")
    rows = rows.repartition("hub").sortWithinPartitions("hub", "role", "own")

    def check(batches):
        hub = base = None
        with np.errstate(over="ignore"):
            for batch in batches:
                out = []
                text = utf8(batch.column("_text"))
                names = ("hub", "role", "a", "own", "n", "h1", "h2")
                columns = zip(text, *(batch.column(c).to_pylist() for c in names))
                for t, key, role, a, own, *facts in columns:
                    # An id may be repeated with another text, which is not this class.
                    if list(_facts(shingles([t], words)[0])[:3]) != facts:
                        continue
                    if role == 0:
                        hub, base = (key, a), _exact(t, words)
                    elif hub == (key, a):
                        other = _exact(t, words)
                        both = len(base & other)
                        if 100 * both >= percent * (len(base) + len(other) - both):
                            out.append((a, own))
                a, b = zip(*out) if out else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return staged(rows.mapInArrow(check, "a long, b long"), "shingle-links")


def copy_pairs(classes):
    """(a, b): every class with the smallest class that shares one of its bands."""
    bands = classes.select("cid", F.explode(F.sequence(F.lit(0), F.lit(COORDINATES // BAND - 1))).alias("_band"), "signature")
    at = f"substring(signature, _band * {4 * BAND} + 1, {4 * BAND})"
    bands = bands.select("cid", F.xxhash64("_band", F.expr(at)).alias("_key"))
    hubs = bands.groupBy(F.col("_key").alias("_hub_key")).agg(F.min("cid").alias("a"), F.count("*").alias("_n"))
    pairs = bands.join(hubs.where("_n > 1"), F.col("_key") == F.col("_hub_key"))
    return pairs.where("a <> cid").select("a", F.col("cid").alias("b")).distinct()


def _value(at):
    return F.expr(f"substring(signature, ({at}) * 4 + 1, 4)")


def candidate_links(classes, percent=PERCENT):
    """(a, b): forests over the classes of different components whose signatures match in enough coordinates.

    Every class with such a match is in a forest, with every class it matches. ``classes`` has cid,
    component, n and signature.
    """
    facts = classes.select("cid", "component", "n", "signature")
    posted = facts.select("*", F.explode(F.sequence(F.lit(0), F.lit(PREFIX - 1))).alias("last")).select(
        F.xxhash64("last", _value("last")).alias("key"), "cid", "component", "last",
        F.expr("shiftleft(1L, last)").alias("path"),
    )
    merged = []
    for depth in range(1, DEPTH + 1):
        posted = staged(posted, "postings")
        lists = posted.groupBy(F.col("key").alias("_key")).agg(
            F.count("*").alias("_size"), F.min("component").alias("_low"), F.max("component").alias("_high")
        )
        # Lists of one class or of linked classes have nothing to merge.
        open_lists = posted.join(lists.where("_low < _high"), F.col("key") == F.col("_key"))
        long = F.col("_size") > LONG_LIST
        merged.append(open_lists.where(~long if depth < DEPTH else F.lit(True)).select("key", "cid", "path", "last", "_size"))
        if depth == DEPTH:
            break
        again = open_lists.where(long).select("key", "cid", "component", "last", "path")
        again = again.join(facts.select(F.col("cid").alias("_c"), "signature"), F.col("cid") == F.col("_c"))
        # The match after this one lies behind it and leaves room for those still needed.
        again = again.where(f"last < {PREFIX + depth - 1}").select(
            "*", F.explode(F.sequence(F.col("last") + 1, F.lit(PREFIX + depth - 1))).alias("next")
        )
        posted = again.select(
            F.xxhash64("key", "next", _value("next")).alias("key"), "cid", "component", F.col("next").alias("last"),
            F.expr("path + shiftleft(1L, next)").alias("path"),
        )
    rows = merged[0]
    for more in merged[1:]:
        rows = rows.unionByName(more)
    chunks = F.ceil(F.col("_size") / CHUNK)
    rows = rows.select("*", F.pmod(F.xxhash64("cid", "key"), chunks).alias("_own"), chunks.alias("_chunks"))
    rows = rows.select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)).alias("_met")
    ).select(
        F.xxhash64("key", F.least("_own", "_met"), F.greatest("_own", "_met")).alias("piece"), "cid", "path", "last",
        (F.col("_own") > F.col("_met")).cast("int").alias("side"),
    )
    rows = rows.join(facts.select(F.col("cid").alias("_c"), "component", "n", "signature"), F.col("cid") == F.col("_c")).drop("_c")
    rows = rows.repartition("piece").sortWithinPartitions("piece", "n", "cid")
    return rows.select("piece", "cid", "path", "last", "side", "component", "n", "signature").mapInArrow(
        lambda batches: _merge(batches, percent), "a long, b long"
    )


def _merge(batches, percent):
    """A forest of the matching pairs of each run of postings, sorted by set size."""
    bits = np.int64(1) << np.arange(COORDINATES, dtype=np.int64)
    for table, starts in runs(batches):
        column = lambda name: table.column(name).to_numpy()  # noqa: B023, E731
        cid, path, last, side, component, n = map(column, ("cid", "path", "last", "side", "component", "n"))
        signature = _signatures(table)
        out = []
        for a, b in zip(starts, np.append(starts[1:], len(cid))):
            crossed = side[a:b].any()
            # Sizes ascend: from each class on, those at most 100 / percent times as large.
            ends = a + np.searchsorted(n[a:b], n[a:b] * 100 // percent, "right")
            counts = ends - np.arange(a, b) - 1
            pairs = []
            for lo, hi in _parts(counts):
                reach = counts[lo:hi]
                x = np.repeat(np.arange(a + lo, a + hi), reach)
                y = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach) + x + 1
                keep = (component[x] != component[y]) & (path[x] == path[y])
                if crossed:
                    keep &= side[x] != side[y]
                x, y = x[keep], y[keep]
                same = signature[x] == signature[y]
                keep = same.sum(1) >= MATCHES
                x, y, same = x[keep], y[keep], same[keep]
                # The list's coordinates must be the pair's first matches; else another list has it.
                first = (same * bits).sum(1) & ((np.int64(2) << last[x].astype(np.int64)) - 1)
                keep = first == path[x]
                pairs.append((x[keep] - a, y[keep] - a))
            out.append(_forest_of(pairs, cid[a:b]))
        yield _links(out)


def _signatures(table):
    raw = b"".join(table.column("signature").to_pylist())
    return np.frombuffer(raw, np.uint32).reshape(table.num_rows, COORDINATES)


def _forest_of(pairs, names):
    """(node, root) names of a forest over pairs of positions."""
    x, y = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
    if not len(x):
        return names[:0], names[:0]
    roots = forest(x, y, len(names))
    hung = np.flatnonzero(roots != np.arange(len(names)))
    return names[hung], names[roots[hung]]


def _links(parts):
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])


def confirm_groups(candidates, classes, docs, words=WORDS, percent=PERCENT):
    """(a, b): forests of the confirmed links between classes of different components.

    ``candidates`` are links (a, b) whose groups, with the links known already, hold all pairs to check.
    """
    known = classes.select(F.col("cid").alias("_c"), "component")
    touched = candidates.select("a").union(candidates.select("b")).distinct().toDF("cid")
    touched = staged(touched.join(known, F.col("cid") == F.col("_c")).select("cid", "component"), "touched")
    joined = candidates.unionByName(touched.select(F.col("cid").alias("a"), F.col("component").alias("b")))
    groups = components(joined).select(F.col("node").alias("_node"), "root")
    members = touched.select("cid").join(groups, F.col("cid") == F.col("_node")).select("cid", F.col("root").alias("group"))
    sizes = members.groupBy(F.col("group").alias("_group")).agg(F.ceil(F.count("*") / GROUP_CHUNK).alias("_chunks"))
    members = members.join(sizes, F.col("group") == F.col("_group"))
    members = members.select("cid", "group", "_chunks", F.pmod(F.xxhash64("cid"), F.col("_chunks")).alias("_own"))
    members = members.select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)).alias("_met")
    ).select(
        F.xxhash64("group", F.least("_own", "_met"), F.greatest("_own", "_met")).alias("piece"), "cid",
        (F.col("_own") > F.col("_met")).cast("int").alias("side"),
    )
    facts = classes.select(F.col("cid").alias("_cid"), "component", "first", "n", "h1", "h2", "signature")
    rows = members.join(facts, F.col("cid") == F.col("_cid")).drop("_cid")
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
    rows = rows.join(texts, F.col("first") == F.col("_doc"))
    rows = rows.select("piece", "cid", "side", "component", "n", "h1", "h2", "signature", "_text")
    rows = rows.repartition("piece").sortWithinPartitions("piece", "n", "cid")
    return staged(
        rows.mapInArrow(lambda batches: _confirm_runs(batches, words, percent), "a long, b long"), "group-links"
    )


def _confirm_runs(batches, words, percent):
    with np.errstate(over="ignore"):
        for table, starts in runs(batches):
            column = lambda name: table.column(name).to_numpy()  # noqa: B023, E731
            cid, side, component, n, h1, h2 = map(column, ("cid", "side", "component", "n", "h1", "h2"))
            signature = _signatures(table)
            text = utf8(table.column("_text"))
            out = []
            for a, b in zip(starts, np.append(starts[1:], len(cid))):
                sets = [shingles([t], words)[0] for t in text[a:b]]
                # An id may be repeated with another text, which is not this class.
                own = [_facts(found)[:3] == (n[a + i], h1[a + i], h2[a + i]) for i, found in enumerate(sets)]
                crossed, pairs = side[a:b].any(), []
                ends = a + np.searchsorted(n[a:b], n[a:b] * 100 // percent, "right")
                for x in range(a, b):
                    y = np.arange(x + 1, ends[x - a])
                    y = y[component[y] != component[x]]
                    if crossed:
                        y = y[side[y] != side[x]]
                    y = y[(signature[y] == signature[x]).sum(1) >= MATCHES] if len(y) else y
                    y = np.array([j for j in y - a if own[j] and own[x - a]], np.int64)
                    if not len(y):
                        continue
                    base = sets[x - a]
                    others = np.concatenate([sets[j] for j in y])
                    at = np.minimum(np.searchsorted(base, others), len(base) - 1)
                    lengths = np.array([len(sets[j]) for j in y])
                    both = np.add.reduceat((base[at] == others).astype(np.int64), np.cumsum(lengths) - lengths)
                    similar = y[100 * both >= percent * (len(base) + lengths - both)]
                    pairs.append((np.full(len(similar), x - a), similar))
                out.append(_forest_of(pairs, cid[a:b]))
            yield _links(out)


def _parts(counts):
    """Ranges of rows with at most about ``PAIRS`` pairs in all."""
    step = np.cumsum(counts) // PAIRS
    starts = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]]))
    return zip(starts, np.append(starts[1:], len(counts)))


def _with_components(classes, links):
    roots = components(links)
    joined = classes.join(roots.select(F.col("node").alias("_node"), "root"), F.col("cid") == F.col("_node"), "left")
    return joined.withColumn("component", F.coalesce("root", "cid")).drop("_node", "root")


def _grouped(docs, words, percent):
    """(doc_id, text_hash, n, group, component_id) per row; ``group`` numbers what links reach."""
    signed = staged(signatures(docs, words), "signatures")
    usable = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = staged(
        usable.groupBy("n", "h1", "h2")
        .agg(F.min("doc_id").alias("first"), F.any_value("signature").alias("signature"))
        .select("*", F.monotonically_increasing_id().alias("cid")),
        "text-classes",
    )
    links = confirm(staged(copy_pairs(classes), "copy-pairs"), classes, docs, words, percent)
    known = staged(_with_components(classes, links), "text-components")
    candidates = staged(candidate_links(known, percent), "candidate-links")
    if not candidates.isEmpty():
        links = links.unionByName(confirm_groups(candidates, known, docs, words, percent))
        known = _with_components(classes, links)
    smallest = known.groupBy(F.col("component").alias("_c")).agg(F.min("first").alias("_component"))
    known = known.join(smallest, F.col("component") == F.col("_c")).select(
        F.col("n").alias("_n"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "component", "_component"
    )
    same = (F.col("n") == F.col("_n")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    out = usable.join(known, same).select(
        "doc_id", "text_hash", "n", F.col("component").alias("group"), F.col("_component").alias("component_id")
    )
    alone = signed.where("n = 0 OR doc_id IS NULL").select(
        "doc_id", "text_hash", "n", F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("component_id")
    )
    return out.unionByName(alone)


def near_duplicates(docs, words=WORDS, percent=PERCENT):
    """One row per document: its set's size, the smallest id reachable by links, and whether that is its own."""
    return _grouped(docs, words, percent).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def drop_near_duplicates(docs, words=WORDS, percent=PERCENT):
    """The documents with one of every group left, the one with the smallest id; all columns are kept.

    Texts without words and rows without id all stay. Where rows repeat an id, each text counts by itself:
    of a group's texts with the smallest id, one row of the text with the least hash stays; of rows that
    repeat both, the least by their other columns that have an order.
    """
    kept = _grouped(docs, words, percent).where("doc_id = component_id")
    worded = kept.where("n > 0").groupBy("doc_id", "group").agg(F.min("text_hash").alias("text_hash"), F.max("n").alias("n"))
    chosen = worded.select("doc_id", "text_hash", "n").unionByName(
        kept.where("n = 0").select("doc_id", "text_hash", "n").distinct()
    )
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_chosen"), F.col("n").alias("_n"))
    ordered = [F.col(f"`{c}`") for c, kind in docs.dtypes if c != "text" and "map<" not in kind and "variant" not in kind]
    packed = docs.select(
        F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_hash"), F.struct(*ordered).alias("_order"),
        F.struct("*").alias("_row"),
    )
    joined = packed.join(chosen, (F.col("_doc") == F.col("_id")) & (F.col("_hash") == F.col("_chosen")))
    one = joined.where("_n > 0").groupBy("_doc", "_hash").agg(F.min_by("_row", "_order").alias("_row"))
    rest = joined.where("_n = 0").select("_row").unionByName(packed.where("_doc IS NULL").select("_row"))
    return one.select("_row").unionByName(rest).select("_row.*")
