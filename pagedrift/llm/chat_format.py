"""Preference formatting: the longest common turn prefix of two conversations as one prompt, and masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagedrift.llm.common import heavy_keys, joined, saved

#: A turn is a header that is never trained on, "<|role|>" on a line of its own, the text, and this end, which is.
END = "<|end|>\n"
FIRST_TURN = -(1 << 63)
#: Code points and turns up to which a pair is one row; a longer pair is a row for each of its turns.
LONGEST, MOST_TURNS = 1 << 24, 2000


def _spoken(turns: DataFrame) -> DataFrame:
    return turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(FIRST_TURN)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def swapped_answers(turns: DataFrame) -> DataFrame:
    """Preferences for a table that has none: (pair_id, side, turn, role, text).

    Each conversation is chosen, under its own id. Rejected is the same conversation with its last assistant's turn
    answered by the last assistant's turn of its neighbour: conversation 2k is neighbour of 2k + 1. Without such a turn on
    either side, or without a neighbour, that turn is left out. Of several rows of one last turn the largest text counts as
    the answer, and all of them are replaced by one.
    """
    rows = _spoken(turns)
    last = rows.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    last = saved(last)
    total = rows.count()
    busy = heavy_keys(rows, ["conv_id"], total)
    told = joined(rows, last, ["conv_id"], busy, "left")
    answer = (F.col("role") == "assistant") & (F.col("turn") == F.col("last"))
    answers = told.where(answer).groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    other = F.col("conv_id").bitwiseXOR(F.lit(1).cast("long"))
    theirs = answers.select(other.alias("conv_id"), F.col("text").alias("theirs"))
    # A conversation without an answer gets none.
    swapped = answers.select("conv_id", "turn").join(theirs, "conv_id").select("conv_id", "turn", F.lit("assistant").alias("role"), F.col("theirs").alias("text"))
    chosen = rows.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text")
    same = told.where(~F.coalesce(answer, F.lit(False))).select("conv_id", "turn", "role", "text")
    return chosen.union(same.union(swapped).select("conv_id", F.lit("rejected"), "turn", "role", "text"))


def segments(spoken: DataFrame) -> DataFrame:
    """Render spoken(pair_id, side, turn, role, text), a row for each turn of a pair's parts: pair_id, part, turn, role,
    segment, trained_from, n_chars.

    side is chosen or rejected. part is prompt for the turns before the first that differs, rendered once, from the chosen
    side; the other turns are chosen or rejected. trained_from is the code point of the segment from which loss is taken, its
    length where none is: only what assistants say in a completion is trained on, without its header. Parts read in order of
    turn.

    A null role is 'unknown', a null text empty, a null turn before all others. Rows without a pair or a side give nothing; a
    pair with one side has no prompt. Rows of one side with the same turn are compared as a multiset and rendered each. No
    conversation is gathered in one task: turns are counted by (pair, turn, role, text), and a pair's first difference is an
    aggregate that is joined back; pairs with more than a thousandth of the rows are joined by broadcast.
    """
    rows = spoken.where("pair_id IS NOT NULL AND side IN ('chosen', 'rejected')").select(
        "pair_id",
        "side",
        F.coalesce(F.col("turn").cast("long"), F.lit(FIRST_TURN)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = saved(rows)
    said = [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "role", "text").alias("h2")]
    balance = rows.select("pair_id", "turn", F.when(F.col("side") == "chosen", 1).otherwise(-1).alias("one"), *said).groupBy("pair_id", "turn", "h1", "h2").agg(F.sum("one").alias("n"))
    differs = balance.groupBy("pair_id").agg(F.min(F.when(F.col("n") != 0, F.col("turn"))).alias("differs"))
    told = joined(rows, differs, ["pair_id"], heavy_keys(rows, ["pair_id"], rows.count()))
    common = F.col("differs").isNull() | (F.col("turn") < F.col("differs"))
    head = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))
    segment = F.concat(head, F.col("text"), F.lit(END))
    part = F.when(common, "prompt").otherwise(F.col("side"))
    trains = ~common & (F.col("role") == "assistant")
    return told.where(~common | (F.col("side") == "chosen")).select("pair_id", part.alias("part"), "turn", "role", segment.alias("segment"), F.when(trains, F.length(head)).otherwise(F.length(segment)).cast("long").alias("trained_from"), F.length(segment).cast("long").alias("n_chars"))


def _spans(s: Column) -> Column:
    """Spans [start, end) of what is trained on in the segments s, end to end: "start-end", parted by commas."""
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["n_chars"]
        span = F.concat((acc["at"] + x["trained_from"]).cast("string"), F.lit("-"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(x["trained_from"] < x["n_chars"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(s, none, step)["spans"], ",")


def records(found: DataFrame, longest: int = LONGEST, most_turns: int = MOST_TURNS) -> DataFrame:
    """Training records of segments(): pair_id, piece, prompt, chosen, rejected, chosen_trained, rejected_trained.

    A pair of up to `longest` code points and `most_turns` segments is one row, piece 0. A longer pair, which no task should
    gather, is a row for each segment, in order of piece: its turn. The pieces' texts, end to end, are the pair's, and their
    spans count from the piece's start. Spans are "start-end" in code points of the completion, parted by commas: where loss
    is taken. Texts of a part that a row doesn't have are empty.
    """
    found = saved(found)
    sizes = found.groupBy("pair_id").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("n"))
    large = saved(sizes.where((F.col("chars") > longest) | (F.col("n") > most_turns)).select("pair_id"))
    apart = found.join(large, "pair_id", "left_semi")
    s = F.struct("turn", "role", "segment", "trained_from", "n_chars")
    parts = found.join(large, "pair_id", "left_anti").groupBy("pair_id", "part").agg(F.array_sort(F.collect_list(s)).alias("s"))
    whole = parts.select("pair_id", F.lit(0).cast("long").alias("piece"), "part", F.array_join("s.segment", "").alias("text"), _spans(F.col("s")).alias("spans"))
    alone = apart.select("pair_id", F.col("turn").alias("piece"), "part", F.col("segment").alias("text"), F.when(F.col("trained_from") < F.col("n_chars"), F.concat(F.col("trained_from").cast("string"), F.lit("-"), F.col("n_chars").cast("string"))).otherwise("").alias("spans"))
    of = lambda part, c: F.when(F.col("part") == part, F.col(c)).otherwise("")
    columns = [("prompt", "prompt", "text"), ("chosen", "chosen", "text"), ("rejected", "rejected", "text"), ("chosen_trained", "chosen", "spans"), ("rejected_trained", "rejected", "spans")]
    together = whole.groupBy("pair_id", "piece").agg(*[F.max(of(part, c)).alias(name) for name, part, c in columns])
    return together.unionByName(alone.select("pair_id", "piece", *[of(part, c).alias(name) for name, part, c in columns]))


def preferences(spoken: DataFrame) -> DataFrame:
    """records() of segments() of spoken(pair_id, side, turn, role, text)."""
    return records(segments(spoken))
