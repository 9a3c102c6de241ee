"""Figures by group of outlets, and the rules that keep any one outlet from being read out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Contributing outlets that a published group has at least; what counts as short or long; health limits.
LEAST_OUTLETS = 3
NEWEST, SHORT_CHARS, SHORT_SHARE, LONG_SHARE = 50, 200, 0.3, 3
OK_BELOW, DEGRADED_BELOW = 0.1, 0.4


def ratio(part: Column, whole: Column) -> Column:
    """Share to four digits, half to even; null of nothing."""
    return F.bround(part / F.when(whole != 0, whole), 4)


def health_label(short: Column, errors: Column, sample: Column) -> Column:
    share = (short + errors) / sample
    return F.when(sample == 0, "no_data").when(share < OK_BELOW, "ok").when(share < DEGRADED_BELOW, "degraded").otherwise("failing")


def extraction_health(snapshots: DataFrame) -> DataFrame:
    """Health of each outlet's newest bodies: outlet_id, sample, median_length, short, long, empty, errors, health.

    snapshots: outlet_id, id, fetched_at, body_length, failed. The window keeps 50 rows a task and key before its shuffle.
    """
    w = Window.partitionBy("outlet_id").orderBy(F.desc("fetched_at"), F.desc("id"))
    newest = snapshots.select("outlet_id", "body_length", "failed", F.row_number().over(w).alias("n")).where(F.col("n") <= NEWEST)
    told = newest.withColumn("median", F.median("body_length").over(Window.partitionBy("outlet_id")))
    n, m = F.col("body_length"), F.col("median")
    out = told.groupBy("outlet_id").agg(
        F.count("*").alias("sample"),
        F.first("median").alias("median_length"),
        F.count_if(n < F.greatest(F.lit(float(SHORT_CHARS)), F.lit(SHORT_SHARE) * m)).alias("short"),
        F.count_if((m != 0) & (n > LONG_SHARE * m)).alias("long"),
        F.count_if(n == 0).alias("empty"),
        F.count_if("failed").alias("errors"),
    )
    return out.withColumn("health", health_label(F.col("short"), F.col("errors"), F.col("sample")))


def group_figures(outlets: DataFrame) -> DataFrame:
    """Sums by group: all outlets, each language, each tier.

    outlets: language, tier, discovered, captured, attempted, snapshots, archived. One pass over partial sums. Gives
    grp, key, outlets, contributing, the sums, capture_rate and archive_rate.
    """
    sums = ["discovered", "attempted", "captured", "snapshots", "archived"]
    found = outlets.groupingSets([[], [F.col("language")], [F.col("tier")]], "language", "tier").agg(
        F.grouping_id().alias("g"), F.count("*").alias("outlets"), F.count_if(F.col("snapshots") > 0).alias("contributing"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]
    )
    grp = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "language").otherwise("tier")
    key = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, F.col("language")).otherwise(F.col("tier"))
    return found.select(grp.alias("grp"), key.alias("key"), "outlets", "contributing", *sums, ratio(F.col("captured"), F.col("attempted")).alias("capture_rate"), ratio(F.col("archived"), F.col("snapshots")).alias("archive_rate"))


def withhold_small(figures: DataFrame, columns: list[str], least: int = LEAST_OUTLETS) -> DataFrame:
    """figures with suppressed, reason, and the named columns null where fewer than `least` outlets contribute.

    Name all columns that say something of the contributing outlets, contributing itself among them.
    """
    small = F.col("contributing") < least
    rest = [c for c in figures.columns if c not in columns]
    return figures.select(*rest, *[F.when(~small, F.col(c)).alias(c) for c in columns], small.alias("suppressed"), F.when(small, "small_group").alias("reason"))


Group = tuple[str, str]


def leaks(outlets: int, contributing: int, least: int = LEAST_OUTLETS) -> bool:
    """Whether so few outlets of a set contribute that their figures are theirs alone; or none does, of few."""
    return 0 < contributing < least or (contributing == 0 and 0 < outlets < least)


def plan_suppression(groups: dict[Group, set], cells: dict[object, tuple[int, int]], least: int = LEAST_OUTLETS) -> dict[Group, str]:
    """Groups to withhold, with the reason, so that no few outlets can be had by subtracting disjoint groups from another.

    groups, in the order in which they are judged: (family, key) to the cells that it is made of; cells: how many outlets each
    holds, and how many of them contribute. Outlets of one cell are in the same groups. Of each published group and each
    choice of published disjoint proper parts of it, the rest must not leak; of the first that does, the part with the fewest
    contributing outlets is withheld, of equal ones the first by name, and all is judged anew. For tens of groups.
    """
    held_cells = {g: frozenset(c for c in m if cells[c][0]) for g, m in groups.items()}
    count = lambda some: tuple(sum(cells[c][i] for c in some) for i in range(2))
    weight = {g: count(m)[1] for g, m in held_cells.items()}
    held = {g: "small_group" for g in groups if weight[g] < least}

    def choices(parts: list[Group], rest: frozenset):
        """Choices of disjoint parts within rest, and what they leave: those of earlier parts before those of later ones."""
        yield (), rest
        for i, part in enumerate(parts):
            if held_cells[part] <= rest:
                for some, left in choices(parts[:i], rest - held_cells[part]):
                    yield (*some, part), left

    def first_leak() -> tuple[Group, ...]:
        shown = [g for g in groups if g not in held]
        for whole in shown:
            parts = [g for g in shown if held_cells[g] < held_cells[whole] and g[0] != "all"]
            for some, left in choices(parts, held_cells[whole]):
                if some and leaks(*count(left), least):
                    return some
        return ()

    while found := first_leak():
        held[min(found, key=lambda g: (weight[g], g))] = "complementary"
    return held


def daily(rows: DataFrame, at: str, zone: str = "Asia/Dhaka") -> DataFrame:
    """Rows by local day, with zeros between the first and the last: day, n."""
    counts = rows.groupBy(F.to_date(F.from_utc_timestamp(F.col(at), zone)).alias("day")).agg(F.count("*").alias("n")).where("day IS NOT NULL")
    days = counts.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def published(events: DataFrame, annotations: DataFrame) -> DataFrame:
    """Events that may be counted: confirmed, confirmed by review, and with a published annotation."""
    signed = annotations.where("review_state = 'published'").select("event_id").distinct()
    return events.where("confidence = 'confirmed' AND review_decision = 'confirmed'").join(signed, events["id"] == signed["event_id"], "left_semi")
