"""Near-duplicate documents by MinHash with tensored banding, each link confirmed on the full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagedrift.llm.common import HEAVY_KEYS, HEAVY_ROWS, cut, heavy_keys, joined, lean, parts_for, released, saved, slices, unused

#: Words of a shingle.
SHINGLE = 5
#: Two collections of COLLECTIONS keys of ROWS minhashes each. A table's key joins one key of either collection, so
#: 2 * COLLECTIONS * ROWS minhashes serve COLLECTIONS ** 2 tables of 2 * ROWS rows. Sets of similarity J meet in a table
#: with probability (1 - (1 - J ** ROWS) ** COLLECTIONS) ** 2: 0.99998 for 0.85, 0.08 for 0.3, 0.00014 for 0.1.
COLLECTIONS, ROWS = 12, 3
#: Of the keys of both collections, those that two documents must share to be compared. Sets of similarity 0.85 share fewer
#: with a chance of 0.000001, of 0.8 with 0.0001.
AGREEING = 4
#: Members of a bucket whose pairs are listed; larger buckets are compared in blocks.
PAIRED = 16
#: Documents of a block, and shingles of them, about.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Table keys that a task makes, in bytes.
TABLE_BYTES = 32 << 20
#: Text that is shingled at once, in bytes.
SLAB_BYTES = 1 << 18

_P = 0x9E3779B97F4A7C15 | 1
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _RNG.integers(1, 2**63, 2 * COLLECTIONS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(1, 2**63, 2 * COLLECTIONS * ROWS, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of UTF-8 text, A to Z in lower case, and the places where they start."""
    b = _LOWER[np.frombuffer(data, np.uint8)]
    inside = ~_IS_SPACE[b]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[b] * _powers(len(b), _P), dtype=np.uint64)))
    back = _powers(len(b), pow(_P, -1, 1 << 64))
    return _mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)), starts


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; with fewer words than SHINGLE, of the whole sequence."""
    raw = [(t or "").encode() for t in texts]
    hashes, starts = word_hashes(b"\n".join(raw))
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw)]))
    if len(hashes) >= SHINGLE:
        n = len(hashes) - SHINGLE + 1
        runs = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            runs += hashes[k : k + n] * _PLACE[k]
        runs = _mix(runs)
    out = []
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if e - s >= SHINGLE:
            out.append(np.unique(runs[s : e - SHINGLE + 1]))
        elif e > s:
            out.append(_mix((hashes[s:e] * _PLACE[: e - s]).sum(dtype=np.uint64, keepdims=True) + np.uint64(e - s)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """For each non-empty set the keys of both collections: an array of sets by 2 * COLLECTIONS."""
    flat, at = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    keys = np.zeros((len(sets), 2 * COLLECTIONS), np.uint64)
    for i in range(2 * COLLECTIONS * ROWS):
        least = np.minimum.reduceat(_mix32(flat, i), at)
        keys[:, i // ROWS] = _mix(keys[:, i // ROWS] * np.uint64(_P) + least)
    return keys


def _mix32(x: np.ndarray, i: int) -> np.ndarray:
    """The i-th hash of x: the high halves of a multiply-add, and what they came from, so that equal minima are equal shingles."""
    y = x * _MUL[i] + _ADD[i]
    return y ^ (y >> np.uint64(32))


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for b in slices(batches):
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(text)
            size += len(text or "")
            if size >= SLAB_BYTES or len(ids) >= 2000:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in _slabs(batches):
        sets = shingle_sets(texts)
        some = [i for i, s in enumerate(sets) if len(s)]
        keys: list = [None] * len(ids)
        if some:
            for i, k in zip(some, band_keys([sets[i] for i in some]).astype(np.int64).tolist(), strict=True):
                keys[i] = k
        name = [(int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(_mix(s)))) if len(s) else (0, 0) for s in sets]
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "h1": pa.array([signed(a) for a, _ in name], pa.int64()), "h2": pa.array([signed(b) for _, b in name], pa.int64()), "keys": pa.array(keys, pa.list_(pa.int64()))})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in _slabs(batches):
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "shingles": pa.array([s.view(np.int64) for s in shingle_sets(texts)], pa.list_(pa.int64()))})


def _tensored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 500):
        keys = np.array(part.column(1).flatten()).astype(np.uint64).reshape(part.num_rows, 2, COLLECTIONS)
        joint = _mix(keys[:, 0, :, None] * np.uint64(_P) + keys[:, 1, None, :])
        joint = _mix(joint + np.arange(COLLECTIONS**2, dtype=np.uint64).reshape(COLLECTIONS, COLLECTIONS))
        ids = np.repeat(np.array(part.column(0)), COLLECTIONS**2)
        yield pa.RecordBatch.from_arrays([pa.array(joint.reshape(-1).astype(np.int64)), pa.array(ids, pa.int64())], ["key", "id"])


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many keys each row of a shares with each row of b."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for i in range(a.shape[1]):
        out += a[:, i, None] == b[None, :, i]
    return out


def _compare_blocks(percent: int):
    """Links of a spanning forest of the documents of two blocks of a bucket, or of one, whose sets are similar enough.

    Pairs that are in one component already, share too few keys or differ too much in size are passed over; the sets of the
    others are compared, the likeliest first, unless the links before have connected them.
    """

    def compare(group: pa.Table) -> pa.Table:
        ids, side, known = (np.array(group.column(c), np.int64) for c in ("id", "side", "component"))
        keys = np.array(group.column("keys").combine_chunks().flatten(), np.int64).reshape(len(ids), 2 * COLLECTIONS)
        sets = [np.array(x.values, np.int64) for x in group.column("shingles").combine_chunks()]
        size = np.array([len(x) for x in sets], np.int64)
        a = np.flatnonzero(side == side.min())
        b = np.flatnonzero(side == side.max())
        near = _agreeing(keys[a], keys[b])
        low, high = np.minimum(size[a][:, None], size[b][None, :]), np.maximum(size[a][:, None], size[b][None, :])
        x, y = np.nonzero((near >= AGREEING) & (known[a][:, None] != known[b][None, :]) & (100 * low >= percent * high))
        parent: dict[int, int] = {}

        def root(k: int) -> int:
            while (up := parent.get(k, k)) != k:
                parent[k] = parent.get(up, up)
                k = up
            return k

        out = []
        for i in np.argsort(-near[x, y].astype(np.int64), kind="stable").tolist():
            p, q = int(a[x[i]]), int(b[y[i]])
            r, t = root(int(known[p])), root(int(known[q]))
            if r != t:
                both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                if 100 * both >= percent * (size[p] + size[q] - both):
                    parent[r] = t
                    out.append((int(ids[p]), int(ids[q])))
        released()
        return pa.table({"a": pa.array([v for v, _ in out], pa.int64()), "b": pa.array([w for _, w in out], pa.int64())})

    return compare


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): (id, root), root the smallest id reachable, for every id of an edge.

    Rounds of large-star and small-star; each cuts its lineage with a checkpoint. A star is joined to its centre's least
    neighbour by a join on the centre, by broadcast for centres of very many neighbours, so no neighbourhood is gathered in
    one place.
    """
    def star(e: DataFrame, large: bool, n: int) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        busy = heavy_keys(both, ["u"], 2 * n)
        if not large:
            both = both.where("v < u")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = joined(both, least, ["u"], busy)
        if large:
            out = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def state(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        return r["n"], r["x"]

    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    now = state(edges)
    while now[0]:
        edges = cut(star(cut(star(edges, True, now[0])), False, now[0]))
        before, now = now, state(edges)
        if before == now:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()


def _narrow(docs: DataFrame, ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Rows of docs whose doc_id is among ids: ids are broadcast if there are at most `most`, 16 MB, and else shuffled."""
    return docs.join(F.broadcast(ids) if ids.count() <= most else ids, "doc_id", "left_semi")


def classes(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Near-duplicate classes of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are `[^\\x20\\x09-\\x0D]+` with A to Z in lower case; a document's set has its distinct 5-word shingles, or the
    whole sequence of fewer words. Documents are linked if 100 * intersection >= percent * union; component_id is the
    smallest doc_id reachable and kept tells whether that is the row's own. Null or empty texts have no set and are linked
    with nothing. Rows with a null doc_id link nothing: component_id is null and kept true. Rows with equal ids are equal
    documents if their texts' sets are; else each is a row of its own under the id, which joins their components.

    Other columns play no part.

    Documents with equal sets are one representative from the start, so a group of copies costs one row. In each bucket every
    representative is first compared with the least one, its centre: as many pairs as rows, and enough to connect families of
    near copies. Only buckets in which some member isn't in its centre's component are looked at again, once for equal
    members, and only for pairs of members of two components: listed in buckets of at most PAIRED members, and in larger ones
    block against block, in tasks that return a spanning forest. So pairs of a large family are never written, and
    comparisons don't outgrow the pairs that meet in buckets.
    """
    lean(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = saved(rows.mapInArrow(_sketch, "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>"))
    name = ["h1", "h2", "n_shingles"]
    some = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = saved(some.groupBy(*name).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    reps = same.select(F.col("rep").alias("doc_id"), *name)
    known = saved(some.join(reps, ["doc_id", *name]).dropDuplicates(["doc_id", *name]).select(F.col("doc_id").alias("id"), "n_shingles", "keys"))
    n_tasks = parts_for(known.count() * COLLECTIONS**2 * 16, TABLE_BYTES)
    buckets = known.select("id", "keys").repartition(n_tasks).mapInArrow(_tensored, "key long, id long")
    in_order = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = saved(buckets.select("key", "id", F.min("id").over(in_order).alias("centre")).where("id <> centre"))

    def alike(pairs: DataFrame) -> DataFrame:
        """Of pairs(a, b) those that share enough keys and are of like enough size."""
        side = lambda c: known.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("keys").alias(f"k{c}"))
        both = joined(pairs, side("a"), ["a"], heavy_keys(pairs, ["a"], pairs.count())).join(side("b"), "b")
        shared = F.size(F.filter(F.zip_with("ka", "kb", lambda x, y: x == y), lambda same: same))
        return both.where((shared >= AGREEING) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))).select("a", "b").distinct()

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of pairs(a, b) those whose whole sets are similar enough."""
        pairs = saved(pairs)
        wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        sets = sets_of(wanted)
        first, second = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        inter = F.size(F.array_intersect("sa", "sb"))
        # Sets of a pair are of like size, so the broadcast sets of hot centres are a thousandth of what all pairs ship.
        both = joined(pairs, first, ["a"], heavy_keys(pairs, ["a"], pairs.count())).join(second, "b")
        return both.where(100 * inter >= percent * (F.size("sa") + F.size("sb") - inter)).select("a", "b")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return saved(_narrow(rows, cut(wanted)).mapInArrow(_sets, "doc_id long, shingles array<long>").dropDuplicates(["doc_id", "shingles"]).withColumnRenamed("doc_id", "id"))

    pairs = saved(met.select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct())
    root = components(confirmed(alike(pairs)))
    rest = _unsettled(met, pairs, root)
    if rest is not None:
        few = rest.where((F.col("n") <= PAIRED) & ~F.col("whole"))
        other = few.select("grp", F.col("id").alias("b"), F.col("component").alias("other"))
        listed = few.select("grp", F.col("id").alias("a"), "component").join(other, "grp").where("a < b AND component <> other").select("a", "b").distinct()
        links = confirmed(alike(saved(listed.join(pairs, ["a", "b"], "left_anti"))))
        wide = rest.where((F.col("n") > PAIRED) | F.col("whole"))
        large = wide.join(known, "id")
        if not large.isEmpty():
            sizes = large.groupBy("whole", "grp").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("of"))
            blocks = saved(joined(large, sizes, ["whole", "grp"], heavy_keys(wide, ["whole", "grp"], wide.count())).withColumn("block", F.pmod(F.xxhash64("id"), F.col("of")).cast("int")))
            other = F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other")
            placed = blocks.select("whole", "grp", "id", "component", "keys", "block", other).select("whole", "grp", "id", "component", "keys", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"))
            met_blocks = placed.join(sets_of(blocks.select(F.col("id").alias("doc_id")).distinct()), "id")
            links = links.union(met_blocks.groupBy("whole", "grp", "x", "y").applyInArrow(_compare_blocks(percent), "a long, b long"))
        root = components(links.union(root.select(F.col("id").alias("a"), F.col("root").alias("b"))))
    total = sketch.count()
    busy = same.where(F.col("copies") * HEAVY_KEYS > total).select(*name)
    hot = busy.collect() if total >= HEAVY_ROWS else []  # fewer than HEAVY_KEYS rows
    busy = sketch.sparkSession.createDataFrame(hot, busy.schema) if hot else None
    own = joined(sketch.select("doc_id", *name), same.drop("copies"), name, busy, "left")
    # A document's id may stand for several sets; all of them hang on its id.
    repeated = sketch.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count() > 0
    if repeated:
        hang = own.where("n_shingles > 0 AND rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        root = components(hang.union(root.select(F.col("id").alias("a"), F.col("root").alias("b"))))
        return sketch.select("doc_id", "n_shingles").join(root.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"), F.coalesce(F.coalesce("root", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
    own = own.withColumn("rep", F.coalesce("rep", "doc_id"))
    named = root.withColumnRenamed("id", "rep")
    rep = same.where(F.col("copies") * HEAVY_KEYS > total).select("rep")
    found = joined(own, named, ["rep"], own.sparkSession.createDataFrame(rep.collect(), rep.schema) if hot else None, "left")
    found = found.withColumn("component_id", F.coalesce("root", "rep"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def _unsettled(met: DataFrame, pairs: DataFrame, root: DataFrame) -> DataFrame | None:
    """Members of groups that the comparison with centres leaves open: whole, grp, id, component, n (members); None if there
    are none.

    A bucket is open if it has three members at least and one that isn't in its centre's component; of buckets with equal
    members one stands for all. Open buckets that share members are a family. Where the square of a family is at most the sum
    of the squares of its buckets, as for near copies, which meet in most tables, the group is the whole family, so that each
    pair is compared once; else, as for documents that boilerplate chains together, the groups are the buckets. So there are
    never more comparisons than pairs in buckets.
    """
    place = lambda c: root.select(F.col("id").alias(c), F.col("root").alias(f"of_{c}"))
    told = joined(pairs, place("a"), ["a"], heavy_keys(pairs, ["a"], pairs.count()), "left").join(place("b"), "b", "left")
    told = told.select("a", "b", F.coalesce("of_a", "a").alias("of_a"), F.coalesce("of_b", "b").alias("of_b"))
    rows = met.join(told.select(F.col("a").alias("centre"), F.col("b").alias("id"), "of_a", "of_b"), ["centre", "id"])
    rows = saved(rows)
    h = F.xxhash64("id")
    facts = rows.groupBy("key", "centre").agg((F.count("*") + 1).alias("n"), F.max(F.col("of_a") != F.col("of_b")).alias("open"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 16)).alias("s"))
    open_ = saved(facts.where("open AND n > 2").groupBy("centre", "n", "x", "s").agg(F.min("key").alias("key")).select("key", "n"))
    if open_.isEmpty():
        return None
    members = rows.select("key", "id", F.col("of_b").alias("component")).union(rows.select("key", "centre", "of_a").distinct())
    members = saved(members.join(open_, "key").select("key", "id", "component", "n").distinct())
    family = components(members.join(members.groupBy("key").agg(F.min("id").alias("least")), "key").select(F.col("id").alias("a"), F.col("least").alias("b")))
    told = saved(members.join(family, "id"))
    squares = told.select("root", "key", "n").distinct().groupBy("root").agg(F.sum(F.col("n") * F.col("n")).alias("in_buckets"))
    sizes = family.groupBy("root").agg(F.count("*").alias("m")).join(squares, "root").where("m * m <= in_buckets").select("root", F.col("m"))
    judged = joined(told, sizes, ["root"], heavy_keys(told, ["root"], told.count()), "left").withColumn("whole", F.col("m").isNotNull())
    return saved(judged.select("whole", F.when(F.col("whole"), F.col("root")).otherwise(F.col("key")).alias("grp"), "id", "component", F.coalesce("m", "n").alias("n")).distinct())


def keep_first(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of docs that classes() keeps, with all their columns. Rows with equal ids go or stay together."""
    name = unused(docs, "_kept")
    kept = classes(docs, percent).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept[name]), "left_semi")
