"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagedrift.llm.common import bound, cut, unused, words
from pagedrift.llm.line_dedup import LAST_ID

SHINGLE = 5
#: Share of an item's distinct shingles that a document must hold.
CONTAINMENT = 0.8
#: Rows of 16 bytes that are broadcast at most; more are shuffled.
BROADCAST_ROWS = 1_000_000


def _runs(df: DataFrame, sizes: list[int]) -> DataFrame:
    """df with, for each k of sizes, as run<k> the hashes of the runs of k words of column text, in order."""
    spelled = words(F.lower(F.col("text").cast("string")))

    def hashed(w: Column) -> Column:
        at = lambda k: F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1)))
        run = lambda k: F.when((F.get(w, F.lit(0)) != "") & (F.size(w) >= k), F.transform(at(k), lambda i: F.xxhash64(F.slice(w, i, k)))).otherwise(F.array().cast("array<bigint>"))
        return F.struct(*[run(k).alias(f"run{k}") for k in sizes])

    return df.withColumn("_runs", bound(spelled, hashed)).select(*df.columns, *[F.col(f"_runs.run{k}") for k in sizes])


def sketch_size(span: int) -> int:
    """Least hashes kept of a window of 2 * span shingles.

    An item of more than span / 2 distinct shingles, 0.8 of them present, goes unseen only if none of those is among its
    window's least distinct ones: with this size a chance under 0.0001 for any span, and none up to span 8.
    """
    return 16 + span // 2


def _window_sketches(runs: Column, span: int) -> Column:
    """The MinHash sketches, bottom-k, of windows of 2 * span shingles that start every span shingles, in one array.

    Any stretch of up to span + 1 shingles lies within one window. A shingle that repeats in a window takes one of the k
    places, not all.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.size(runs), F.lit(1)), F.lit(span))
    k = min(sketch_size(span), 2 * span)
    return F.flatten(F.transform(starts, lambda i: F.slice(F.sort_array(F.array_distinct(F.slice(runs, i, 2 * span))), 1, k)))


def leaks(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """Pairs of docs(doc_id, text) and items(item_id, text) whose item lies in the document: doc_id, item_id, n_shingles,
    n_found, containment.

    A document holds an item if it has at least `containment` of the item's distinct 5-word shingles (words in lower case).
    An item of fewer words has one shingle, all its words, which may stand anywhere in a document.

    Items are partitioned by distinct shingles into spans, powers of two. For each span in use, a long document is cut into
    overlapping windows of twice the span, so that item and window are of like size, and each window keeps the least hashes
    of its shingles. Items meet windows that share a hash of both sketches; exact containment in the whole document confirms
    each pair. For each number of words under five in use, all runs of so many words of a document are looked up, for a
    sketch of one shingle is that shingle.

    Null and empty texts hold nothing and are held by nothing. Rows with a null doc_id are one document with a null id in
    the result; of rows with equal ids the best containment counts, as for items. Empty tables give an empty result; other
    columns play no part.
    """
    named = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    every = range(1, SHINGLE + 1)
    most = F.greatest(*[F.when(F.size(f"run{k}") > 0, F.lit(k)).otherwise(0) for k in every])
    spelled = _runs(named, list(every)).withColumn("k", most).where("k > 0")
    of_item = F.coalesce(*[F.when(F.col("k") == k, F.array_distinct(f"run{k}")) for k in every])
    spelled = spelled.select("item_id", "k", of_item.alias("set")).withColumn("n", F.size("set"))
    spelled = cut(spelled.withColumn("span", F.greatest(F.lit(4), F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("int"))))
    in_use = spelled.select("k", "span").distinct().collect()  # a row for each power of two, and for each k under five
    schema = "doc_id long, item_id long, n_shingles long, n_found long, containment double"
    if not in_use:
        return docs.sparkSession.createDataFrame([], schema)
    sizes = sorted({r["k"] for r in in_use})
    spans = sorted(r["span"] for r in in_use if r["k"] == SHINGLE)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.col("text").cast("string").alias("text"))
    size = F.lit(16) + F.floor(F.col("span") / 2).cast("int") + F.ceil((1 - containment) * F.col("n")).cast("int") + 1
    asked = cut(spelled.select("item_id", F.explode(F.slice(F.sort_array("set"), F.lit(1), size)).alias("hash")))
    few = asked.count() <= BROADCAST_ROWS
    sketches = [_window_sketches(F.col(f"run{SHINGLE}"), s) for s in spans] + [F.col(f"run{k}") for k in sizes if k < SHINGLE]
    sketched = _runs(keyed, sizes).select("doc", F.explode(F.array_distinct(F.concat(*sketches))).alias("hash"))
    met = cut(sketched.join(F.broadcast(asked) if few else asked, "hash").select("doc", "item_id").distinct())
    wanted = met.select("doc").distinct()
    wanted = F.broadcast(wanted) if met.count() <= BROADCAST_ROWS else wanted
    sets = _runs(keyed.join(wanted, "doc", "left_semi"), sizes).drop("text")
    of_doc = F.coalesce(*[F.when(F.col("k") == k, F.col(f"run{k}")) for k in sizes])
    tested = met.join(F.broadcast(spelled) if few else spelled, "item_id").join(sets, "doc").select("doc", "item_id", F.col("n").alias("n_shingles"), F.size(F.array_intersect("set", of_doc)).alias("n_found"))
    found = tested.where(F.col("n_found") >= F.lit(containment) * F.col("n_shingles")).withColumn("containment", F.col("n_found") / F.col("n_shingles"))
    best = found.groupBy("doc", "item_id").agg(F.max(F.struct("containment", "n_shingles", "n_found")).alias("b"))
    return best.select(F.when(F.col("doc") != LAST_ID, F.col("doc")).alias("doc_id"), "item_id", F.col("b.n_shingles").cast("long").alias("n_shingles"), F.col("b.n_found").cast("long").alias("n_found"), F.col("b.containment").alias("containment"))


def clean(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    name = unused(docs, "_doc")
    found = leaks(docs, items, containment).select(F.coalesce("doc_id", F.lit(LAST_ID)).alias(name)).distinct()
    return docs.join(found, F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST_ID)) == found[name], "left_anti")
