"""As-of joins: union and running last, in two levels.

Rows of both sides are put in one order and each left row takes the last right row before it. A window over a whole key
would put each key in one task, so time is cut into slots: within a slot the running last is a window over (key, slot);
what a slot begins with is the last value of the slots before, found on one row for each key and slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def running_last(frame: DataFrame, keys: list[str], slot: str, order: list[Column], values: dict[str, Column], dealt: bool = False) -> DataFrame:
    """`frame` with, for each of `values`, its last value that is not null so far, by `order`, in rows of equal `keys`.

    `slot` is a column that never falls along the order; rows of one slot should fit a task. Keys must not be null. The result is
    dealt by keys and slot; a frame that is already so (`dealt`) is not shuffled again. Rows and summaries are read from one
    shuffle, so what comes before runs once.
    """
    frame = frame if dealt else frame.repartition(*keys, slot)
    seen = Window.partitionBy(*keys, slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    ends = frame.groupBy(*keys, slot).agg(*[F.max_by(v, F.when(v.isNotNull(), place)).alias(f"_start_{name}") for name, v in values.items()])
    starts = ends.select(*keys, slot, *[F.last(f"_start_{name}", ignorenulls=True).over(ahead).alias(f"_start_{name}") for name in values])
    inside = frame.withColumns({f"_seen_{name}": F.last(v, ignorenulls=True).over(seen) for name, v in values.items()})
    found = inside.join(starts, [*keys, slot])
    found = found.withColumns({name: F.coalesce(f"_seen_{name}", f"_start_{name}") for name in values})
    return found.drop(*[f"_{kind}_{name}" for name in values for kind in ("seen", "start")])


def lagged(frame: DataFrame, keys: list[str], slot: str, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """`frame` with, for each of `values`, its value in the row before, by `order`, in rows of equal `keys`; null in the first.

    `slot` is as in running_last: windows are over (key, slot), and a slot's first row takes the last row of the slot before.
    """
    frame = frame.repartition(*keys, slot)
    row, place = F.struct(*[v.alias(n) for n, v in values.items()]), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    ends = frame.groupBy(*keys, slot).agg(F.max_by(row, place).alias("_end"))
    starts = ends.select(*keys, slot, F.lag("_end").over(Window.partitionBy(*keys).orderBy(slot)).alias("_start"))
    inside = frame.withColumn("_before", F.lag(row).over(Window.partitionBy(*keys, slot).orderBy(*order)))
    found = inside.join(starts, [*keys, slot]).withColumn("_before", F.coalesce("_before", "_start"))
    return found.withColumns({n: F.col(f"_before.{n}") for n in values}).drop("_before", "_start")


def time_slot(at: Column, slot_ms: int = DAY_MS) -> Column:
    """The slot of a time; rows without time have one before all others."""
    return F.coalesce(F.floor(at / slot_ms), F.lit(-(1 << 62))).cast("long")


def slot_width(*frames: DataFrame, keys: list[str], time: str = "timestamp", most: int = 5_000_000, widest: int = DAY_MS) -> int:
    """The widest slot, of a day halved as often as need be, in which no key has more than some `most` rows of all `frames`, by their
    counts of quarter hours: what `slot_ms` should be where keys are that busy. A quarter of an hour at least."""
    quarter = 900_000
    counts = None
    for frame in frames:
        own = frame.groupBy(*keys, F.floor(F.col(time) / quarter).alias("_q")).agg(F.count("*").alias("n"))
        counts = own if counts is None else counts.unionByName(own)
    widths = [widest]
    while widths[-1] >= 2 * quarter:
        widths.append(widths[-1] // 2)
    counts = counts.select(*keys, F.explode(F.array(*[F.struct(F.lit(w).alias("width"), F.floor(F.col("_q") * quarter / w).alias("slot")) for w in widths])).alias("s"), "n")
    fits = counts.groupBy(*keys, "s").agg(F.sum("n").alias("n")).groupBy("s.width").agg(F.max("n").alias("n")).filter(F.col("n") <= most)
    return fits.agg(F.max("width")).first()[0] or widths[-1]


def first_if_null(at: Column) -> Column:
    return F.coalesce(at, F.lit(-(1 << 62)))


def asof(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], time: str = "timestamp", tie: str | None = None, direction: str = "backward", strict: bool = False, tolerance_ms: int | None = None, slot_ms: int = DAY_MS) -> DataFrame:
    """`left` and, for each row, the right row's `values` and `match_<time>`, null if there is no match.

    backward: the last right row at or before the left time (before it if strict); forward: the first one at or after it
    (after it if strict). Of right rows at one time that with the highest `tie` wins, backward and forward. A right row
    whose values are null matches too. A match farther than `tolerance_ms` is none. Right rows without time are ignored,
    left rows without time have no match. Columns of `left` that have the names of the result's are replaced.
    """
    sign = 1 if direction == "backward" else -1
    out = [f"match_{time}", *values]
    left = left.drop(*[c for c in out if c in left.columns])
    kept = [c for c in left.columns if c not in keys]
    match = F.struct(F.col(time).alias("at"), *[F.col(v).alias(v) for v in values])
    right = right.filter(F.col(time).isNotNull()).select(*keys, F.col(time).cast("long").alias("_at"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("_tie"), match.alias("_match"), F.lit(None).cast(left.select(F.struct(*kept)).schema[0].dataType).alias("_left"))
    rows = left.select(*keys, F.col(time).cast("long").alias("_at"), F.lit(None).cast("long").alias("_tie"), F.lit(None).cast(right.schema["_match"].dataType).alias("_match"), F.struct(*kept).alias("_left"))
    both = rows.withColumn("_side", F.lit(0 if strict else 1)).unionByName(right.withColumn("_side", F.lit(1 if strict else 0)))
    both = both.withColumn("_slot", time_slot(F.col("_at") * sign, slot_ms))
    # Left rows without time come first, so they see nothing.
    order = [first_if_null(F.col("_at") * sign), F.col("_side"), F.coalesce("_tie", F.lit(0))]
    found = running_last(both, keys, "_slot", order, {"_found": F.col("_match")}).filter("_left IS NOT NULL")
    if tolerance_ms is not None:
        found = found.withColumn("_found", F.when(F.abs(F.col("_at") - F.col("_found.at")) <= tolerance_ms, F.col("_found")))
    return found.select(*keys, "_left.*", F.col("_found.at").alias(out[0]), *[F.col(f"_found.{v}").alias(v) for v in values])


def forward_fill(frame: DataFrame, keys: list[str], columns: list[str], time: str = "timestamp", tie: list[str] | None = None, slot_ms: int = DAY_MS) -> DataFrame:
    """Nulls of `columns` take the last value before them in the same keys. Rows without time are not filled from others."""
    order = [first_if_null(F.col(time)), *[F.col(t) for t in tie or []]]
    rows = frame.withColumn("_slot", time_slot(F.col(time), slot_ms))
    filled = running_last(rows, keys, "_slot", order, {f"_filled_{c}": F.col(c) for c in columns})
    return filled.withColumns({c: F.coalesce(F.col(c), f"_filled_{c}") for c in columns}).drop("_slot", *[f"_filled_{c}" for c in columns])


def asof_filled(left: DataFrame, rights: dict[str, DataFrame], keys: list[str], time: str = "timestamp", slot_ms: int = DAY_MS) -> DataFrame:
    """`left` and, for each name of `rights` (keys, time, a column of that name), `<name>`: the value of the last row at or before
    the left time, filled forward over left rows where that value is null; and `<name>_age`: the time since that row.

    All sides are joined in one pass, and filled in a second one over the same partitions: each side is shuffled once.
    """
    kept = [c for c in left.columns if c not in keys]
    none = {name: F.lit(None).cast(f"struct<at:bigint,val:{r.schema[name].dataType.simpleString()}>") for name, r in rights.items()}
    rows = left.select(*keys, F.col(time).cast("long").alias("_at"), F.lit(1).alias("_side"), F.struct(*kept).alias("_left"), *[v.alias(f"_m_{n}") for n, v in none.items()])
    blank = F.lit(None).cast(rows.schema["_left"].dataType)
    for name, right in rights.items():
        match = F.struct(F.col(time).cast("long").alias("at"), F.col(name).alias("val"))
        side = right.filter(F.col(time).isNotNull()).select(*keys, F.col(time).cast("long").alias("_at"), F.lit(0).alias("_side"), blank.alias("_left"), *[(match if n == name else v).alias(f"_m_{n}") for n, v in none.items()])
        rows = rows.unionByName(side)
    order = [first_if_null(F.col("_at")), F.col("_side")]
    rows = rows.withColumn("_slot", time_slot(F.col("_at"), slot_ms))
    matched = running_last(rows, keys, "_slot", order, {f"_f_{n}": F.col(f"_m_{n}") for n in rights}).filter("_left IS NOT NULL")
    filled = running_last(matched, keys, "_slot", order, {f"_v_{n}": F.col(f"_f_{n}.val") for n in rights}, dealt=True)
    return filled.select(*keys, "_left.*", *[x for n in rights for x in (F.col(f"_v_{n}").alias(n), (F.col("_at") - F.col(f"_f_{n}.at")).alias(f"{n}_age"))])
