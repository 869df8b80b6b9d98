"""Data-quality rules: one aggregation of a frame gives all its rules' counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ValidationRules
from .align import first_column
from .asof import DAY_MS, first_if_null, lagged, time_slot

CORE = ("open", "high", "low", "close", "volume", "funding_rate", "open_interest")
MINUTE_MS = 60_000


def _bad(condition: Column) -> Column:
    return F.sum(F.coalesce(condition, F.lit(False)).cast("long"))


def modality_rules(modality: str, columns: list[str], rules: ValidationRules) -> dict[str, Column]:
    """Rule -> condition that a bad row meets, of the rules that are on and whose columns exist."""
    c = F.col
    known: dict[str, tuple[str, tuple[str, ...], Column]] = {
        "klines": (
            ("high_gte_low", ("high", "low"), c("high") < c("low")),
            ("close_positive", ("close",), c("close") <= 0),
        ),
        "aggTrades": (
            ("trade_count_gte_zero", ("trade_count",), c("trade_count") < 0),
            ("volume_gte_zero", ("base_volume",), c("base_volume") < 0),
        ),
        "depth": (("bid_lte_ask", ("best_bid", "best_ask"), c("best_bid") > c("best_ask")),),
        "liquidations": (
            ("valid_side", ("side",), ~F.coalesce(c("side").isin("BUY", "SELL"), F.lit(False))),
            ("quantity_gt_zero", ("quantity",), c("quantity") <= 0),
        ),
    }.get(modality, ())
    found = {rule: bad for rule, needs, bad in known if rules.on(modality, rule) and set(needs) <= set(columns)}
    if modality == "funding" and not rules.on("funding", "allow_missing"):
        value = first_column_or_none(columns, ("funding_rate", "last_funding_rate"))
        if value:
            found["missing_value"] = c(value).isNull() | F.isnan(c(value).cast("double"))
    return found


def first_column_or_none(columns: list[str], names: tuple[str, ...]) -> str | None:
    return next((n for n in names if n in columns), None)


def timestamp_report(frame: DataFrame, modality: str, rules: ValidationRules = ValidationRules(), keys: tuple[str, ...] = (), row_order: str | None = None) -> DataFrame:
    """(keys, rule, bad_count): times out of order, repeated, and gaps over the limit, all by the rows' own order.

    `row_order` is a column of that order (a row number given on reading); without it rows are taken in the order of their
    times, in which none is out of order. Rows are looked at in slots of a day, or of a million row numbers.
    """
    limit = rules.gap_seconds.get(modality, rules.max_gap_seconds) * 1000
    by = F.col(row_order or "timestamp")
    rows = frame.withColumn("_slot", time_slot(by, 1_000_000 if row_order else DAY_MS)).select(*keys, "timestamp", by.alias("_by"), "_slot")
    rows = lagged(rows, list(keys), "_slot", [first_if_null(F.col("_by"))], {"_last": F.col("timestamp")})
    rows = rows.select(*keys, "timestamp", (F.col("timestamp") - F.col("_last")).alias("delta"))
    counts = rows.groupBy(*keys).agg(_bad(F.col("delta") < 0).alias("not_monotonic"), (F.count("timestamp") - F.countDistinct("timestamp")).alias("duplicate_timestamps"), _bad(F.col("delta") > limit).alias("gaps"))
    names = ["not_monotonic", *([] if rules.allow_duplicates else ["duplicate_timestamps"]), "gaps"]
    return counts.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("bad_count")) for n in names])).alias("r")).select(*keys, "r.*")


def rule_counts(frame: DataFrame, modality: str, rules: ValidationRules = ValidationRules()) -> DataFrame:
    """(rule, bad_count) of a modality's rules, in one pass without a shuffle of rows."""
    found = modality_rules(modality, frame.columns, rules)
    if not found:
        return frame.sparkSession.createDataFrame([], "rule string, bad_count long")
    counts = frame.agg(*[F.coalesce(_bad(bad), F.lit(0)).alias(rule) for rule, bad in found.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("bad_count")) for r in found])).alias("r")).select("r.*")


def validate(frame: DataFrame, modality: str, rules: ValidationRules = ValidationRules(), row_order: str | None = None) -> tuple[bool, list[str]]:
    """(valid, errors) of a whole frame, times being looked at symbol by symbol if there are symbols; an empty frame is invalid.
    Depth needs its two prices if snapshots must be complete."""
    if frame.isEmpty():
        return False, ["Empty DataFrame"]
    errors = []
    if "timestamp" in frame.columns:
        keys = ("symbol",) if "symbol" in frame.columns else ()
        times = timestamp_report(frame, modality, rules, keys, row_order).groupBy("rule").agg(F.sum("bad_count").alias("bad_count"))
        errors += [f"{modality} {r.rule}: {r.bad_count}" for r in times.collect() if r.bad_count]
    errors += [f"{modality} {r.rule}: {r.bad_count} rows" for r in rule_counts(frame, modality, rules).collect() if r.bad_count]
    if modality == "depth" and rules.on("depth", "bid_lte_ask") and rules.on("depth", "snapshot_complete"):
        missing = [c for c in ("best_bid", "best_ask") if c not in frame.columns]
        if missing:
            errors.append(f"depth snapshot lacks {', '.join(missing)}")
    return not errors, errors


def quality_report(state: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """For each key: total_records, duplicate_rows (whole rows), gap_count (over a minute), largest_gap_ms, missing_<column>,
    <column>_observed_pct (2 places), funding and open-interest coverage (4 places), quality_score."""
    columns = [c for c in CORE if c in state.columns]
    order = Window.partitionBy(*keys).orderBy("timestamp")
    rows = state.withColumn("_delta", F.col("timestamp") - F.lag("timestamp").over(order))
    report = rows.groupBy(*keys).agg(
        F.count("*").alias("total_records"), _bad(F.col("_delta") > MINUTE_MS).alias("gap_count"), F.coalesce(F.max("_delta"), F.lit(0)).alias("largest_gap_ms"),
        (F.count("*") - F.countDistinct(F.struct(*state.columns))).alias("duplicate_rows"), *[(F.count("*") - F.count(c)).alias(f"missing_{c}") for c in columns],
    )
    total = F.col("total_records")
    report = report.withColumns({f"{c}_observed_pct": F.bround((1 - F.col(f"missing_{c}") / total) * 100, 2) for c in columns})
    report = report.withColumns({f"{c}_coverage": F.bround((total - F.col(f"missing_{c}")) / total, 4) for c in columns if c in ("funding_rate", "open_interest")})
    missing = sum((F.col(f"missing_{c}") for c in columns), F.lit(0))
    score = 100.0 - F.least(F.col("gap_count") * 1.0, F.lit(30.0)) - F.least(F.col("duplicate_rows") * 5.0, F.lit(20.0)) - F.least(missing * 0.5, F.lit(20.0))
    return report.withColumn("quality_score", F.greatest(score, F.lit(0.0)))


def incomplete_history(files: DataFrame) -> DataFrame:
    """Catalogue rows of bars that lack constituents."""
    return files.filter((F.col("dataset_type") == "klines") & (F.col("status") == "RESAMPLED_INCOMPLETE")).select("symbol", "interval", "year", "month")


def resample_statistics(files: DataFrame) -> DataFrame:
    """(symbol, name, rows, status) of resampled files; name is interval_year_month."""
    own = files.filter((F.col("dataset_type") == "klines") & (F.col("interval") != "1m"))
    return own.select("symbol", F.concat_ws("_", "interval", "year", "month").alias("name"), F.coalesce("row_count", F.lit(0)).alias("rows"), F.coalesce("status", F.lit("UNKNOWN")).alias("status"))


def keep_first(frame: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of rows with equal keys the first by `order`."""
    return frame.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def nulls_after_first(frame: DataFrame, column: str, keys: tuple[str, ...] = ("symbol",), time: str = "timestamp") -> DataFrame:
    """For each key: the first time that `column` has a value, and the nulls after it."""
    seen = F.col(column).isNotNull()
    rows = frame.select(*keys, time, seen.alias("_seen"))
    first = rows.groupBy(*keys).agg(F.min(F.when(F.col("_seen"), F.col(time))).alias("first_valid"))  # a row for each key
    counted = rows.join(first, list(keys)).groupBy(*keys)
    return counted.agg(F.max("first_valid").alias("first_valid"), _bad(~F.col("_seen") & (F.col(time) > F.col("first_valid"))).alias("nulls_after"))


def interval_ratio(fine: DataFrame, coarse: DataFrame, low: float = 4.0, high: float = 6.0, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """For each key: rows of `fine` over rows of `coarse`, and whether that is within limits."""
    a, b = fine.groupBy(*keys).agg(F.count("*").alias("fine_rows")), coarse.groupBy(*keys).agg(F.count("*").alias("coarse_rows"))
    return a.join(b, list(keys)).withColumn("ratio", F.col("fine_rows") / F.col("coarse_rows")).withColumn("ok", F.col("ratio").between(low, high))


__all__ = ["first_column", "modality_rules", "timestamp_report", "rule_counts", "validate", "quality_report", "incomplete_history", "resample_statistics", "keep_first", "nulls_after_first", "interval_ratio"]
