"""Line dedup by a deletion-neighbourhood join over words, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagedrift.llm.common import HEAVY_KEYS, SPACE_CLASS, bound, cut, heavy_keys, joined, saved, unused

#: Lines of fewer words have no near copies, only exact ones: one edit of five words leaves a similarity of 0.8.
LEAST_WORDS = 5
#: Rows of 16 bytes that are broadcast at most; more are shuffled. A run has up to four such broadcasts, 64 MB in all.
BROADCAST_ROWS = 1_000_000
LAST_ID = (1 << 63) - 1


def _spread(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def _hashed(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def _row(docs: DataFrame) -> list[Column]:
    """What tells documents apart and puts them in order: the id, then a hash of the text, so that rows are one document only
    if both are equal."""
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST_ID)), F.xxhash64(docs["text"].cast("string"))]


def _lines(docs: DataFrame) -> DataFrame:
    """Lines that have words: doc, tie, pos, and plain, the line's words parted by single blanks."""
    doc, tie = _row(docs)
    lines = docs.select(doc.alias("doc"), tie.alias("tie"), F.posexplode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")).alias("pos", "line"))
    return lines.select("doc", "tie", "pos", _plain(F.col("line")).alias("plain")).where("plain <> ''")


def _plain(line: Column) -> Column:
    """A line with its words parted by single blanks; lines that are so already pass unchanged."""
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for x in ("  ", "\t", "\x0b", "\f", "\r"):
        odd = odd | F.contains(line, F.lit(x))
    return F.when(odd, F.btrim(F.regexp_replace(line, SPACE_CLASS, " "))).otherwise(line)


def _count(plain: Column) -> Column:
    return F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit(" "), F.lit(""))) + 1


def _halves(plain: Column, n: Column) -> Column:
    """Keys of a line's halves. Two lines within one edit share the first half of the shorter one, or its second half."""

    def of(m: Column) -> list[Column]:
        h = F.floor(m / 2).cast("int")
        part = lambda k: F.call_function("substring_index", plain, F.lit(" "), k)
        return [F.xxhash64(F.lit("<"), m, part(h)), F.xxhash64(F.lit(">"), m, part(h - m))]

    return F.array(*of(n), *of(n - 1))


def _within_one(a: Column, b: Column) -> Column:
    """Whether one insertion, deletion or substitution of a word, or none, turns one array of words into the other."""
    longer, shorter = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))

    def common(x: Column, y: Column) -> Column:
        same = F.zip_with(F.slice(x, F.lit(1), shorter), F.slice(y, F.lit(1), shorter), lambda p, q: p == q)
        at = F.array_position(same, F.lit(False))
        return F.when(at == 0, shorter.cast("long")).otherwise(at - 1)

    return (longer - shorter <= 1) & (common(a, b) + common(F.reverse(a), F.reverse(b)) >= longer - 1)


def dropped_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Lines that go: (doc, tie, drop), drop the positions, from 0, of a document's lines that repeat or nearly repeat an earlier one.

    Lines have an order by doc_id, then a hash of the text, then position. A line is its words; white space between and around
    them doesn't count. It goes if an earlier line has the same words or, from least_words words on, if an earlier line of as
    many is within one edited word of it. A line without words never goes.

    Exact copies, of any length, meet by their hash. For near copies each distinct line emits its deletion neighbourhood,
    the line without its i-th word for each i, as keys (words, i, hash): lines of equal length within one substitution share
    such a key, and its earliest line is the witness against the others; a line with one word more shares a hash with the
    whole of the other, and the earlier of both is a witness. An exact check of the words confirms each. A key has one
    witness and a whole is one line, so no pairs of a group are listed: a line has at most two witnesses for each word.

    First, lines without a partner are set aside without loss: two lines within one edit share a half, so a line whose
    halves no other line has emits nothing. Keys that more than a thousandth of the rows bear, be they lines, variants or
    witnesses, are joined by broadcast and not shuffled.
    """
    lines = _lines(docs)
    long = F.col("n") >= least_words
    counted = lines.withColumn("n", _count(F.col("plain")))
    told = saved(counted.select("doc", "tie", "pos", *_hashed(F.col("plain")), F.when(long, _halves(F.col("plain"), F.col("n"))).alias("halves")))
    where = F.struct("doc", "tie", "pos")
    repeated = saved(told.groupBy("h1", "h2").agg(F.min(where).alias("first"), F.count("*").alias("n")).where("n > 1"))

    halves = told.select("h1", F.explode("halves").alias("half"))
    met = halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("half")
    near = cut(halves.join(_spread(cut(met)), "half", "left_semi").select("h1").distinct())
    found = lines.select(where.alias("at"), "plain", *_hashed(F.col("plain")))
    texts = cut(found.join(_spread(near), "h1", "left_semi").groupBy("h1", "h2").agg(F.min("at").alias("first"), F.first("plain").alias("plain")))

    each = texts.select("h1", "h2", "first", F.posexplode(F.split("plain", " ")).alias("i", "word")).select("h1", "h2", "first", "i", F.xxhash64("word", "i").alias("a"), F.xxhash64("word", F.col("i") - 1).alias("b"))
    to_here = Window.partitionBy("h1", "h2").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("h1", "h2")
    # What stands before the i-th word keeps its place; what stands after it moves up by one.
    sums = each.select("h1", "h2", "first", "i", "a", F.bit_xor("a").over(to_here).alias("a_here"), F.bit_xor("b").over(to_here).alias("b_here"), F.bit_xor("a").over(whole).alias("a_all"), F.bit_xor("b").over(whole).alias("b_all"), F.count("*").over(whole).cast("int").alias("n"))
    without = F.col("a_here").bitwiseXOR(F.col("a")).bitwiseXOR(F.col("b_all")).bitwiseXOR(F.col("b_here"))
    order = F.struct("first", "h1", "h2")
    # One row for each word left out, and one for the whole line, at -1.
    either = F.array(F.struct("i", (F.col("n") - 1).alias("n"), without.alias("hash")), F.when(F.col("i") == 0, F.struct(F.lit(-1).alias("i"), F.col("n"), F.col("a_all").alias("hash"))))
    variants = saved(sums.select(order.alias("line"), F.explode(F.array_compact(either)).alias("v")).select("line", "v.*").withColumn("key", F.xxhash64("n", "i", "hash")))
    total = variants.count()
    deleted, as_is = variants.where("i >= 0"), variants.where("i = -1")
    # Narrow rows first: most keys are of one line, and most hashes of no whole line.
    lines_of = deleted.select("key", F.col("line.h1").alias("h1")).groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b"))
    together = saved(deleted.join(_spread(cut(lines_of.where("a <> b").select("key"))), "key", "left_semi").drop("key"))
    shared = together.groupBy("n", "i", "hash").agg(F.min("line").alias("witness"), F.max("line").alias("last")).where("witness <> last").drop("last")
    substituted = joined(together, shared, ["n", "i", "hash"], heavy_keys(together, ["n", "i", "hash"], total)).select("line", "witness")
    reached = saved(deleted.join(_spread(cut(as_is.select("hash").distinct())), "hash", "left_semi").select(F.col("line").alias("longer"), "n", "hash"))
    wholes = as_is.select(F.col("line").alias("shorter"), "n", "hash")
    inserted = joined(reached, wholes, ["n", "hash"], heavy_keys(reached, ["n", "hash"], total))
    against = saved(substituted.union(inserted.select(F.greatest("longer", "shorter"), F.least("longer", "shorter"))).where("witness < line").distinct())
    spelled = texts.select(order.alias("line"), F.split("plain", " ").alias("words"))
    # Near copies are as long as their witness, so the broadcast ones are together no longer than HEAVY_KEYS average lines.
    seen = joined(against, spelled.select(F.col("line").alias("witness"), F.col("words").alias("of")), ["witness"], heavy_keys(against, ["witness"], total))
    checked = seen.join(spelled, "line").where(_within_one(F.col("words"), F.col("of")))
    gone = checked.select(F.col("line.h1").alias("h1"), F.col("line.h2").alias("h2")).distinct().withColumn("near", F.lit(True))

    facts = saved(repeated.drop("n").join(gone, ["h1", "h2"], "full"))
    occurrences = told.select("doc", "tie", "pos", "h1", "h2")
    busy = repeated.where(F.col("n") * HEAVY_KEYS > told.count()).select("h1", "h2")
    hot = busy.collect()  # fewer than HEAVY_KEYS rows
    judged = joined(occurrences, facts, ["h1", "h2"], docs.sparkSession.createDataFrame(hot, busy.schema) if hot else None)
    goes = F.col("near") | (F.col("first") != where)
    return judged.where(goes).groupBy("doc", "tie").agg(F.collect_set("pos").alias("drop"))


def dedup(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with their columns, text without the lines that dropped_lines() names, and n_lines and n_dropped.

    A null text stays null and has no line; an empty text is one empty line, which stays, as all lines without words do. Rows
    with equal ids and equal texts are one document: what the first holds goes from none of them, what an earlier document
    holds goes from all. Rows with a null id come last in order. Lines keep their order and are joined by \\n. Other columns
    stay as they are, but for columns named n_lines and n_dropped, which the results replace.
    """
    gone = dropped_lines(docs, least_words)
    drop = unused(docs, "_drop")
    names = {c: unused(docs, f"_{c}") for c in ("doc", "tie")}
    gone = gone.select(F.col("doc").alias(names["doc"]), F.col("tie").alias(names["tie"]), F.col("drop").alias(drop))
    doc, tie = _row(docs)
    both = docs.join(gone, (doc == gone[names["doc"]]) & (tie == gone[names["tie"]]), "left")

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
        picked = bound(kept, lambda at: F.struct(F.array_join(F.transform(at, lambda i: F.get(lines, i)), "\n").alias("text"), F.size(lines).alias("n"), (F.size(lines) - F.size(at)).alias("dropped")))
        whole = F.struct(F.col("text").cast("string").alias("text"), F.size(lines).alias("n"), F.lit(0).alias("dropped"))
        return F.when(F.col(drop).isNull(), whole).otherwise(picked)

    kept = unused(docs, "_kept")
    out = both.withColumn(kept, F.when(F.col("text").isNotNull(), bound(F.split(F.col("text").cast("string"), "\n"), rest)))
    columns = [F.col(kept)["text"].alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*columns, *[F.coalesce(F.col(kept)[c], F.lit(0)).cast("long").alias(name) for c, name in (("n", "n_lines"), ("dropped", "n_dropped"))])
