"""N-gram Jaccard join of documents in the Jaccard metric space, exact, by pivots and triangle-inequality windows.

Jaccard distance d(x, y) = 1 - |x & y| / |x | y| is a metric, and two documents link when d <= r.

Level 1: the pivots are the one-shingle sets {s}. d(x, {s}) = 1 - 1/|x| for every s in x and 1 for all others, so the
Voronoi region of x is that of its first shingle in one fixed order of all shingles, rare ones first. x with
d(x, y) <= r lacks at most |x| - ceil((1 - r)|x|) of its shingles in y: that is the width of the window within which x
is replicated as a boundary document to the next regions, and two linked documents always meet in one. The order comes
from counts over all documents; it steers the size of regions and never the result. A small region gives the pairs that
sizes and the place of their common pivot allow.

Level 2: a large region is joined again by a document pivot p, its member of the least hash. Every member's distance to
p is taken; those within r form its ball and are settled. Members outside the largest component of a region are the next
round's region: they meet more pivots, eight times as many in each round, and what no ball takes meets every document of
another component within the window |d(x, p) - d(y, p)| <= r.

Pairs are held against a second bound before any set travels: each set has a vector of counts of its shingles by
buckets, and the distance of two vectors in the L1 metric is at most the symmetric difference of the sets. All rounds
are joins and partial aggregates on Spark keys; no region, component or group of copies is held by one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components, merge_components
from .common import broadcast_if_small, materialize, release, table
from .tokens import WORD_BUCKETS, mix64, shingle_sets

WORDS = 4
PERCENT = 85
#: Shingles that a task counts together, and the count below which one is not reported as frequent.
COUNT_BLOCK = 1 << 22
COUNT_LEAST = 3
#: Longest list of frequent shingles; they are broadcast to order the others before them. Ties and cuts do not
#: change results.
FREQUENT = 1 << 18
#: Count from which the rows of a frequent pivot are never brought to one task.
HOT_ROWS = 1 << 16
#: Members up to which the pairs of a region are looked at one by one.
PAIRED = 64
#: Pivots that a document outside the largest component of its region meets in the rounds before it meets all others.
PIVOTS = (8, 64)
BROADCAST_ROWS = 1_000_000
#: Sets that a task remembers to leave out repeated ones.
REMEMBERED = 1 << 20
#: Shingles for each count of a set's vector, about, and the least length of a vector.
VECTOR_SHARE, VECTOR_LEAST = 4, 32
#: Rows or shingles that a task hands on at once, and numbers of vectors that it compares at once, about.
HANDED_ON, COMPARED = 1 << 18, 1 << 20
#: Steps of a word's level for a doubling of its frequency; levels are far below LAST, where frequent shingles start.
LEVEL_STEPS, LAST = 4, 1 << 32

_SIGN = np.uint64(0x9E3779B97F4A7C15)


def _long(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _signature(s: np.ndarray) -> tuple[int, int]:
    """Two independent sums over a set."""
    return int(mix64(s ^ _SIGN).sum(dtype=np.uint64)), int(mix64(s + _SIGN).sum(dtype=np.uint64))


def set_vector(s: np.ndarray) -> bytes:
    """Counts of a set's shingles by their leading bits; empty, which bounds nothing, where a count exceeds a byte."""
    bits = VECTOR_LEAST.bit_length() - 1
    while len(s) > VECTOR_SHARE << bits:
        bits += 2
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def vector_gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """L1 distance of vectors in rows; longer ones are folded to the length of shorter ones."""
    fold = lambda v, k: v.reshape(len(v), k, -1).sum(2, dtype=np.int64)
    k = min(a.shape[1], b.shape[1])
    return np.abs(fold(a, k) - fold(b, k)).sum(1)


def repeated(s: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that s holds at least so many times, in order, and how often; s is put in order in its place."""
    s.sort()
    same = s[least - 1 :] == s[: len(s) - least + 1]
    same[1:] &= s[1 : len(same)] != s[: max(len(same) - 1, 0)]
    found = s[: len(same)][same]
    return found, np.searchsorted(s, found, "right") - np.flatnonzero(same)


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """Rows (n, sig1, sig2, vector) of documents, (shingle, count) of shingles frequent in a block, (bucket, count) of words."""
    names = ["doc_id", "text_key", "n", "sig1", "sig2", "vector", "shingle", "bucket", "count"]
    schema = pa.schema([(c, pa.binary() if c == "vector" else pa.int64()) for c in names])

    def rows(k, **given):
        columns = [pa.array(given[f.name], f.type) if f.name in given else pa.nulls(k, f.type) for f in schema]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches):
        held, many = None, 0
        word_count = np.zeros(WORD_BUCKETS, np.int64)

        def counted():
            s, c = repeated(held[:many], COUNT_LEAST) if many else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return rows(len(s), shingle=_long(s), count=c)

        for batch in batches:
            k = batch.num_rows
            n, a, b, vectors = np.zeros(k, np.int64), np.zeros(k, np.uint64), np.zeros(k, np.uint64), [b""] * k
            for row, s, _ in shingle_sets(batch.column("text"), size, count=word_count):
                n[row] = len(s)
                if len(s):
                    a[row], b[row] = _signature(s)
                    vectors[row] = set_vector(s)
                    if many + len(s) > (0 if held is None else len(held)):
                        # a block and the set that fills it up
                        wider = np.empty(max(COUNT_BLOCK + COUNT_BLOCK // 64, many + len(s)), np.uint64)
                        wider[:many] = held[:many] if many else 0
                        held = wider
                    held[many : many + len(s)] = s
                    many += len(s)
                if many >= COUNT_BLOCK:
                    yield counted()
                    many = 0
            yield rows(
                k, doc_id=batch.column("doc_id"), text_key=batch.column("text_key"), n=n, sig1=_long(a), sig2=_long(b),
                vector=vectors,
            )
        yield counted()
        seen = np.flatnonzero(word_count)
        yield rows(len(seen), bucket=seen, count=word_count[seen])

    return docs.mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'vector' else 'long'}" for c in names))


def boundary_width(n: int, percent: int) -> int:
    """Shingles of a set of n that a linked set can lack, and one more."""
    return n - -(-percent * n // 100) + 1


def region_rows(docs: DataFrame, size: int, percent: int, statistics) -> DataFrame:
    """(pivot, sig, n, place): each different set of n shingles in the regions of its first ones.

    place: how many shingles of the set come before the pivot; -1 - place where the pivot is hot.
    """

    def run(batches):
        known, order, hot, levels = statistics.value
        seen: set[tuple[int, int]] = set()
        pivots, places, sigs, sizes, widths = [], [], [], [], []

        def handed():
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array(_long(np.concatenate(pivots))),
                    pa.array(_long(np.repeat(np.array(sigs, np.uint64), widths))),
                    pa.array(np.repeat(np.array(sizes, np.int32), widths)),
                    pa.array(np.concatenate(places)),
                ],
                names=["pivot", "sig", "n", "place"],
            )
            for x in (pivots, places, sigs, sizes, widths):
                x.clear()
            return batch

        for batch in batches:
            many = 0
            for _, s, level in shingle_sets(batch.column("text"), size, levels):
                if not len(s) or (sig := _signature(s)) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(sig)
                last, is_hot = level, np.zeros(len(s), bool)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    among = known[at] == s
                    last, is_hot = np.where(among, LAST + order[at], level), among & hot[at]
                first = np.argsort(last, kind="stable")[: boundary_width(len(s), percent)]
                place = np.arange(len(first), dtype=np.int32)
                pivots.append(s[first])
                places.append(np.where(is_hot[first], -1 - place, place).astype(np.int32))
                sigs.append(sig[0])
                sizes.append(len(s))
                widths.append(len(first))
                many += len(first)
                if many >= HANDED_ON:
                    yield handed()
                    many = 0
            if pivots:
                yield handed()

    return docs.mapInArrow(run, "pivot long, sig long, n int, place int")


def region_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of small regions, and members (pivot, a, n, place) of regions of more than PAIRED sets.

    If a pivot is the first that two sets share, they share no more than what follows it in either; a pair that cannot
    link by that and its sizes is left out. rows come by pivot and sig within partitions, those of a hot pivot anywhere.
    A task holds a batch and the members of one small region.
    """
    names = ["pivot", "a", "b", "n", "place"]

    def members(pivot, sig, n, place):
        return pa.RecordBatch.from_arrays(
            [pa.array(pivot), pa.array(sig), pa.nulls(len(sig), pa.int64()), pa.array(n), pa.array(place)], names=names
        )

    def pairs(pivot, sig, n, left):
        a, b = [], []
        for lag in range(1, PAIRED):
            same = np.flatnonzero(pivot[lag:] == pivot[:-lag])
            if not len(same):
                break
            x, y = same, same + lag
            may = (100 + percent) * np.minimum(left[x], left[y]).astype(np.int64) >= percent * (n[x].astype(np.int64) + n[y])
            a.append(sig[x[may]])
            b.append(sig[y[may]])
        if not a:
            return
        found = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
        k = found.shape[1]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64()), pa.array(found[0]), pa.array(found[1]), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32())],
            names=names,
        )

    def joined(parts):
        pivot, sig, n, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        fresh = np.append(True, (pivot[1:] != pivot[:-1]) | (sig[1:] != sig[:-1]) | (n[1:] != n[:-1]))
        return pivot[fresh], sig[fresh], n[fresh], place[fresh]

    def run(batches):
        held, large = None, None  # the region that may go on in the next batch; a large one of which members went out
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            hot = columns[3] < 0
            if hot.any():
                yield members(columns[0][hot], columns[1][hot], columns[2][hot], -1 - columns[3][hot])
                columns = [c[~hot] for c in columns]
            if not len(columns[0]):
                continue
            pivot, sig, n, place = joined([columns] if held is None else [held, columns])
            start = np.flatnonzero(np.append(True, pivot[1:] != pivot[:-1]))
            count = np.diff(np.append(start, len(pivot)))
            many = np.repeat((count > PAIRED) | (pivot[start] == large if large is not None else False), count)
            if many.any():
                yield members(pivot[many], sig[many], n[many], place[many])
            ends = many[-1]
            large = pivot[-1] if ends else None
            keep = slice(start[-1], None)
            held = None if ends else [pivot[keep], sig[keep], n[keep], place[keep]]
            small = np.flatnonzero(~many)
            small = small if ends else small[small < start[-1]]
            yield from pairs(pivot[small], sig[small], n[small], n[small] - place[small])
        if held is not None:
            pivot, sig, n, place = held
            yield from pairs(pivot, sig, n, n - place)

    return rows.mapInArrow(run, "pivot long, a long, b long, n int, place int")


def _may_link(n_a, n_b, percent: int):
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def within_bound(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) set ids of those pairs (a, b) whose vectors allow a link; sets: sid, n, vector."""
    one = lambda c: sets.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("vector").alias(f"v_{c}"))
    met = pairs.join(one("a"), "a").join(one("b"), "b").where(_may_link(F.col("n_a"), F.col("n_b"), percent))

    def run(batches):
        for batch in batches:
            a, b = batch.column("v_a"), batch.column("v_b")
            la, lb = (np.array([len(x.as_buffer()) for x in v], np.int64) for v in (a, b))
            n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            may = np.ones(batch.num_rows, bool)
            for x, y in set(zip(la.tolist(), lb.tolist(), strict=True)):
                if x and y:
                    met = np.flatnonzero((la == x) & (lb == y))
                    step = max(1, COMPARED // max(x, y))
                    for at in (met[k : k + step] for k in range(0, len(met), step)):
                        va, vb = (
                            np.frombuffer(b"".join(v.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1) for v in (a, b)
                        )
                        may[at] = (100 + percent) * (n[at] - vector_gap(va, vb)) >= 2 * percent * n[at]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(may)) for c in (batch.column("a"), batch.column("b"))], names=["a", "b"])

    return met.select("a", "b", "n_a", "n_b", "v_a", "v_b").mapInArrow(run, "a long, b long")


def stored_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(sid, s): the shingles of the sets nodes (sid, sig1, sig2, id, text_key), read from one document each."""
    wanted = nodes.select("sid", "sig1", "sig2", F.col("id").alias("_id"), F.col("text_key").alias("_key"))
    met = docs.join(
        broadcast_if_small(materialize(wanted), BROADCAST_ROWS),
        (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")),
    )

    def handed(ids, sets):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["sid", "s"])

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            sid, one, two = (batch.column(c).to_numpy() for c in ("sid", "sig1", "sig2"))
            ids, sets, many = [], [], 0
            for row, s, _ in shingle_sets(batch.column("text"), size):
                x = int(sid[row])
                if x not in seen and np.array_equal(_long(list(_signature(s))), [one[row], two[row]]):
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(x)
                    ids.append(x)
                    sets.append(_long(s))
                    many += len(s)
                if many >= HANDED_ON:
                    yield handed(ids, sets)
                    ids, sets, many = [], [], 0
            yield handed(ids, sets)

    return met.select("sid", "sig1", "sig2", "text").mapInArrow(run, "sid long, s array<long>").dropDuplicates(["sid"])


def distances(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """(a, b, shared, total): sizes of the intersection and union of the sets of each pair."""
    one = lambda c: store.select(F.col("sid").alias(c), F.col("s").alias(f"s_{c}"))
    met = pairs.join(one("b"), "b").join(one("a"), "a")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return met.select("a", "b", shared.alias("shared"), (F.size("s_a") + F.size("s_b")).alias("both")).select(
        "a", "b", "shared", (F.col("both") - F.col("shared")).alias("total")
    )


def in_components(df: DataFrame, comps: DataFrame, column: str, out: str) -> DataFrame:
    """df with out, the component of column."""
    up = comps.select(F.col("child").alias(column), F.col("parent").alias("_up"))
    return df.join(up, column, "left").withColumn(out, F.coalesce("_up", column)).drop("_up")


def _ends(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def split_regions(members: DataFrame, comps: DataFrame) -> DataFrame:
    """members (pivot, sid, n, place, far) of the regions that hold several components, with c and main, the largest one."""
    placed = in_components(members, comps, "sid", "c")
    sizes = placed.groupBy("pivot", "c").agg(F.count("*").alias("rows"))
    main = sizes.groupBy("pivot").agg(F.max(F.struct("rows", "c"))["c"].alias("main"), F.count("*").alias("comps"))
    return materialize(placed.join(main.where("comps > 1").select("pivot", "main"), "pivot"))


def with_vectors(split: DataFrame, sets: DataFrame) -> DataFrame:
    """split with v, the vector of each document's set as numbers (null where it bounds nothing), and its pivots in order.

    Shingles have one order, so the first pivot that two documents share is the first of either's that the other has.
    """

    def run(batches):
        for whole in batches:
            step = max(1, HANDED_ON * whole.num_rows // max(1, whole.nbytes))
            for batch in (whole.slice(k, step) for k in range(0, whole.num_rows, step)):
                lists = [np.frombuffer(v, np.uint8).astype(np.int16) if v else None for v in batch.column("vector").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array(lists, pa.list_(pa.int16()))], names=["sid", "v"])

    wanted = sets.select("sid", "vector").join(split.select("sid").distinct(), "sid", "left_semi")
    order = F.transform(F.sort_array(F.collect_list(F.struct("place", "pivot"))), lambda x: x["pivot"])
    pivots = split.groupBy("sid").agg(order.alias("pivots"))
    return materialize(split.join(wanted.mapInArrow(run, "sid long, v array<short>").join(pivots, "sid"), "sid"))


def boundary_pairs(split: DataFrame, many: int | None, percent: int) -> DataFrame:
    """Pairs (a, b) of a document outside the largest component of its region and others of the region.

    The others are up to many pivots of its foremost region, or without many all documents of another component in every
    region. Pairs that cannot link by sizes, places, the window that the distances to the region's pivot leave or, where
    split has them, the vectors v of equal lengths are left out. Where split has the documents' pivots, a pair belongs to
    the region of the first that they share and is made there alone.
    """
    columns = [x for x in ("sid", "n", "place", "far", "c", "v", "pivots") if x in split.columns]
    outside = split.where("c <> main")
    if many is not None:
        foremost = F.min(F.struct("place", "pivot"))["pivot"].alias("pivot")
        outside = outside.join(outside.groupBy("sid").agg(foremost), ["sid", "pivot"], "left_semi")
        slot = F.pmod(F.xxhash64(F.lit(many), "sid"), F.lit(many))
        lot = F.struct(F.xxhash64("sid", F.lit(many)), *columns)
        others = split.groupBy("pivot", slot.alias("slot")).agg(F.min(lot).alias("m"), F.first("main").alias("main"))
        others = others.select("pivot", "main", *[F.col("m")[c].alias(c) for c in columns])
    else:
        others = split
    others = others.select("pivot", *[F.col(c).alias(f"{c}2") for c in columns])
    left = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    both = F.col("n") + F.col("n2")
    near = F.lit(True)
    if "v" in columns:
        gap = F.aggregate(F.zip_with("v", "v2", lambda x, y: F.abs(x - y)), F.lit(0), lambda total, x: total + x)
        near = (F.size("v") != F.size("v2")) | ((100 + percent) * (both - gap) >= 2 * percent * both)
    owned = F.get(F.array_intersect("pivots", "pivots2"), F.lit(0)) == F.col("pivot") if "pivots" in columns else F.lit(True)
    met = outside.join(others, "pivot").where(
        (F.col("c") != F.col("c2"))
        & ((F.col("c2") == F.col("main")) | (F.col("sid") < F.col("sid2")) | F.lit(many is not None))
        & ((100 + percent) * left >= percent * both)
        & F.coalesce(F.abs(F.col("far") - F.col("far2")) <= 1 - percent / 100 + 1e-9, F.lit(True))
        & F.coalesce(near, F.lit(True))
        & owned
    )
    return met.select(*_ends("sid", "sid2")).distinct()


def ngram_components(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n_shingles, component (null without shingles) and component_id of each row.

    component tells components apart even where doc_ids repeat or are null; see ngram_jaccard_join.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    sketched = materialize(sketch(docs, size))
    documents = sketched.where("n IS NOT NULL")
    word_count = np.zeros(WORD_BUCKETS)
    for r in sketched.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("count").alias("c")).collect():
        word_count[r["bucket"]] = r["c"]
    levels = np.round(LEVEL_STEPS * np.log2(word_count + 1)).astype(np.int64)
    top = (
        sketched.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("count").alias("c"))
        .orderBy(F.desc("c"), "shingle").limit(FREQUENT).toPandas()
    )
    known, counts = top["shingle"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy()
    rank = np.lexsort((known, counts))
    order = np.empty(len(rank), np.int64)
    order[rank] = np.arange(len(rank))
    by_hash = np.argsort(known)
    statistics = spark.sparkContext.broadcast((known[by_hash], order[by_hash], counts[by_hash] >= HOT_ROWS, levels))

    # each different set once, with the document that it is read from later
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "text_key"))
    sets = materialize(
        documents.where("n > 0").groupBy("sig1", "sig2", "n").agg(first.alias("at"), F.max("vector").alias("vector"))
        .select("sig1", "sig2", "n", "vector", "at.id", "at.text_key", F.monotonically_increasing_id().alias("sid"))
    )

    # level 1: regions of one-shingle pivots
    dealt = F.when(F.col("place") < 0, F.xxhash64("sig")).otherwise(F.col("pivot"))
    rows = region_rows(docs, size, percent, statistics).repartition(dealt).sortWithinPartitions("pivot", "sig", "n")
    regions = materialize(region_pairs(rows, percent))
    by_sig = sets.select(F.col("sid").alias("_sid"), F.col("sig1").alias("_sig"))

    def with_sid(df, column):
        return df.join(by_sig, df[column] == F.col("_sig")).drop(column, "_sig").withColumnRenamed("_sid", column)

    pairs = regions.where("b IS NOT NULL").select("a", "b").distinct()
    same_sig = by_sig.join(by_sig.select(F.col("_sid").alias("b"), "_sig"), "_sig").where("_sid < b").select(F.col("_sid").alias("a"), "b")
    pairs = with_sid(with_sid(pairs, "a"), "b").unionAll(same_sig)
    members = materialize(
        with_sid(regions.where("b IS NULL").select("pivot", F.col("a").alias("sid"), "n", "place"), "sid").distinct()
    )

    # level 2: each large region by a document pivot; documents of small regions by their first neighbour
    leader = members.groupBy("pivot").agg(F.min(F.struct(F.xxhash64("sid"), "sid"))["sid"].alias("leader"))
    led = members.join(leader, "pivot")
    balls = materialize(led.where("leader <> sid").select(*_ends("leader", "sid")).distinct())
    pairs = pairs.select(*_ends("a", "b")).distinct()
    bounded = materialize(within_bound(pairs, sets, percent))
    nodes = bounded.select(F.explode(F.array("a", "b")).alias("sid")).unionAll(members.select("sid")).distinct()
    store = materialize(stored_sets(docs, sets.join(nodes, "sid"), size))
    first = bounded.select(F.explode(F.array(F.struct(F.col("a").alias("me"), F.col("b").alias("by")),
                                             F.struct(F.col("b").alias("me"), F.col("a").alias("by")))).alias("e"))
    first = first.groupBy("e.me").agg(F.min(F.struct(F.xxhash64("e.by"), "e.by"))["by"].alias("by")).select(*_ends("me", "by"))
    measured = materialize(distances(first.unionAll(balls).distinct(), store))
    linked = lambda met: met.where(100 * F.col("shared") >= percent * F.col("total")).select("a", "b")
    comps = connected_components(linked(measured))
    rest = bounded.join(measured, ["a", "b"], "left_anti")
    rest = in_components(in_components(rest, comps, "a", "ca"), comps, "b", "cb").where("ca <> cb").select("a", "b")
    comps = merge_components(comps, linked(distances(rest, store)))

    # regions that several components share: the documents outside the largest one meet more and more pivots, then all
    far = measured.select("a", "b", (1 - F.col("shared") / F.col("total")).alias("far"))
    far = far.unionAll(far.select("b", "a", "far")).select(F.col("a").alias("leader"), F.col("b").alias("sid"), "far")
    led = materialize(led.join(far, ["leader", "sid"], "left").select("pivot", "sid", "n", "place", "far"))
    split = split_regions(led, comps)
    for many in (*PIVOTS, None):
        if split.isEmpty():
            break
        if many is None:
            split = with_vectors(split, sets)
        before = comps
        comps = merge_components(comps, linked(distances(within_bound(boundary_pairs(split, many, percent), sets, percent), store)))
        if many is not None and comps is not before:
            split = split_regions(split.select("pivot", "sid", "n", "place", "far"), comps)

    labelled = materialize(
        in_components(sets.select("sid", "sig1", "sig2", "n", "id"), comps, "sid", "component")
    )
    least = labelled.groupBy("component").agg(F.min("id").alias("component_id"))
    named = labelled.join(least, "component").select("sig1", "sig2", "n", "component", "component_id")
    out = documents.where("n > 0").select("doc_id", "text_key", "n", "sig1", "sig2").join(named, ["sig1", "sig2", "n"])
    release(regions, members, balls, bounded, measured, store)
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component", "component_id").unionAll(
        documents.where("n = 0").select("doc_id", "text_key", "n", F.lit(None).cast("long"), "doc_id")
    )


def ngram_jaccard_join(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs (doc_id long, text string).

    Documents link when 100 * shared >= percent * union of their sets of size-word shingles (A-Z lower-cased, a
    shorter text is one shingle). component_id is the least doc_id reachable by links. Null and empty texts have no
    shingles and link with nothing: their component is their own doc_id. Equal sets link whatever their texts. Rows
    that share a doc_id count as documents of their own, as do rows without one; a component in which no row has a
    doc_id has none. Other columns are ignored; an empty table gives no rows.
    """
    return ngram_components(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def op7_ngram_join(spark, sf_dir) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]
                        for i in range(1, len(w) - 2)]) END AS s
  FROM w
), one AS (
  SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s
), g AS (
  SELECT doc_id, unnest(s) AS g FROM s
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN one x ON x.doc_id = a JOIN one y ON y.doc_id = b
  WHERE 100 * shared.n >= {PERCENT} * (x.n + y.n - shared.n)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM one
  UNION
  SELECT b, c FROM reach JOIN both_ways ON a = reach.doc_id
)
SELECT one.doc_id, n AS n_shingles, min(c) AS component_id FROM one JOIN reach USING (doc_id) GROUP BY 1, 2
"""
