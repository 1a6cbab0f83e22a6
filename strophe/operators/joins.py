"""Joins on intervals and tolerances, and joins that pick what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import overlap


def overlaps(left: DataFrame, right: DataFrame, key: str, width: float) -> DataFrame:
    """Pairs of intervals (a0, a1) and (b0, b1) of one key that overlap by more than nothing.

    Both sides are cut into cells of ``width``, so the join is one on equal keys and cells; a pair that shares several
    cells is taken in the first of them. Intervals of no length never overlap.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width).cast("long"), F.floor(F.col(hi) / width).cast("long")))
    a = left.select("*", cells("a0", "a1").alias("_cell"))
    b = right.withColumnRenamed(key, "_key").select("*", cells("b0", "b1").alias("_b_cell"))
    same = (F.col(key) == F.col("_key")) & (F.col("_cell") == F.col("_b_cell"))
    first = F.floor(F.greatest("a0", "b0") / width).cast("long") == F.col("_cell")
    return a.join(b, same & first & (overlap(*(F.col(c) for c in ("a0", "a1", "b0", "b1"))) > 0)).drop("_key", "_cell", "_b_cell")


def overlap_counts(left: DataFrame, right: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """left(key, a0, a1) with a column for each kind: how many of right(key, type, b0, b1) overlap by more than nothing.

    For series whose intervals fit in a row: each key's are gathered once and looked through for each left row.
    """
    held = right.groupBy(key).agg(F.collect_list(F.struct("type", "b0", "b1")).alias("_e"))  # one series' intervals
    meets = lambda e: overlap(F.col("a0"), F.col("a1"), e["b0"], e["b1"]) > 0
    count = lambda k: F.coalesce(F.size(F.filter("_e", lambda e: (e["type"] == k) & meets(e))), F.lit(0)).cast("long")
    joined = left.join(held, key, "left").withColumn("_e", F.coalesce("_e", F.array().cast(held.schema["_e"].dataType)))
    return joined.withColumns({k: count(k) for k in kinds}).drop("_e")


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], x: str, y: str, rank: str, tolerance: Column, reach: float, agrees: Column | None = None) -> DataFrame:
    """Each left row with the first (by ``rank``) right row of its keys whose ``y`` lies within the tolerance of ``x``.

    reach: the width of the cells that both sides are joined on; a left row is sent to all cells that its tolerance
    touches, three or so where that is about the reach. agrees: what must hold of the first match; it is no reason to
    look for another one. Of right rows that agree in keys and ``y`` only the first can be anyone's match, so the others are
    left out before the join; nor is a left row repeated for more than its cells before it is down to one match in each.
    """
    cell = lambda c: F.floor(c / reach).cast("long")
    a = left.withColumn("_id", F.monotonically_increasing_id()).withColumn("_cell", F.explode(F.sequence(cell(F.col(x) - tolerance), cell(F.col(x) + tolerance))))
    held, own = [c for c in right.columns if c not in keys], left.columns
    order = lambda r: F.struct(r.isNotNull(), r)  # noqa: E731  nulls first, as rows are numbered
    first = lambda row, r: F.min_by(row, order(r))
    b = right.groupBy(*(F.col(k).alias(f"_{k}") for k in keys), F.col(y).alias("_y")).agg(first(F.struct(*held), F.col(rank)).alias("_m")).withColumn("_at", cell(F.col("_y")))
    on = (F.col("_cell") == F.col("_at")) & (F.abs(F.col(x) - F.col("_y")) <= tolerance)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    pairs = a.join(b, on).groupBy("_id").agg(F.first(F.struct(*own)).alias("_l"), first(F.col("_m"), F.col(f"_m.{rank}")).alias("_m"))
    found = pairs.select(*(F.col(f"_l.{c}").alias(c) for c in own), *(F.col(f"_m.{c}").alias(c) for c in held))
    return found if agrees is None else found.where(agrees)


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed job still has to do."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def last_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the last in order: an update of a dictionary."""
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where("_rn = 1").drop("_rn")


def outer_by_key(key: list[str], first: DataFrame, *others: DataFrame) -> DataFrame:
    """Artifacts of one thing side by side; what is missing is null."""
    for o in others:
        first = first.join(o, key, "left")
    return first


def audited(logs: DataFrame, audits: DataFrame, key: str) -> DataFrame:
    """Logs of applied plans whose audit passed, or that were never audited."""
    state = audits.select(F.col(key).alias("_k"), F.col("status").alias("_audit"))
    joined = logs.where(F.col("used_ai_strategy") & (F.col("status") == "applied")).join(state, F.col(key) == F.col("_k"), "left")
    return joined.where(F.col("_k").isNull() | (F.col("_audit") == "passed")).drop("_k", "_audit")


def with_overrides(rows: DataFrame, overrides: DataFrame, key: str, defaults: dict[str, float]) -> DataFrame:
    """Settings by row: a key's own where it has one, the general ones elsewhere."""
    own = overrides.select(F.col(key).alias("_k"), *(F.col(n).alias(f"_{n}") for n in defaults))
    joined = rows.join(own, F.col(key) == F.col("_k"), "left")
    return joined.withColumns({n: F.coalesce(f"_{n}", F.lit(d)) for n, d in defaults.items()}).drop("_k", *(f"_{n}" for n in defaults))


def united_keys(a: Column, b: Column) -> Column:
    """The keys of two maps, each once, in order."""
    keys = lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>"))
    return F.array_sort(F.array_union(keys(a), keys(b)))


def first_of_each(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first rows of each key, as a sample that everyone can repeat."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rn") <= most).drop("_rn")
