"""Experiment planning and bookkeeping: parameter grids, bandits, relations of patterns, content hashes, cup backtest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simulation as X
from .joins import non_overlapping
from .shapes import cups

#: Fields that differ between runs over the same inputs.
VOLATILE = frozenset({
    "built_at", "generated_at", "created_at", "updated_at", "started_at", "finished_at", "exported_at", "timestamp", "run_id",
    "duration_seconds", "elapsed_seconds", "event_ledger_path", "research_paper_report_path", "report_path", "report_json_path", "report_md_path", "backup_path", "path",
})


def _canonical(c: Column, kind: T.DataType, volatile: frozenset[str]) -> Column:
    if isinstance(kind, T.StructType):
        kept = sorted((f for f in kind.fields if f.name not in volatile), key=lambda f: f.name)
        parts = [_canonical(c[f.name], f.dataType, volatile).alias(f.name) for f in kept]
        return F.when(c.isNotNull(), F.struct(*parts)) if parts else F.when(c.isNotNull(), F.lit("{}"))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _canonical(x, kind.elementType, volatile))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.filter(F.map_entries(c), lambda e: ~e["key"].cast("string").isin(*volatile)) if volatile else F.map_entries(c))
        return F.transform(entries, lambda e: F.struct(e["key"].cast("string").alias("key"), _canonical(e["value"], kind.valueType, volatile).alias("value")))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    return c if isinstance(kind, (T.StringType, T.BooleanType, T.IntegralType)) else c.cast("string")


def content_hash(df: DataFrame, columns: list[str] | None = None, volatile: frozenset[str] = VOLATILE) -> Column:
    """SHA-256 of the row's canonical JSON: names sorted at every depth, volatile fields left out, non-finite numbers null, nulls kept.

    Maps become sorted lists of entries, other types their text. The order of columns and map entries does not matter.
    """
    names = sorted(c for c in (columns or df.columns) if c not in volatile)
    row = F.struct(*[_canonical(F.col(f"`{c}`"), df.schema[c].dataType, volatile).alias(c) for c in names])
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def parameter_grid(spark: SparkSession, grid: dict[str, list[float]], budget: int, seed: int = 0) -> DataFrame:
    """The grid's combinations (trial, one column an axis): all, if the budget allows.

    Else each axis cycles through a permutation of its own until the longest axis is covered, and the rest of the budget is filled
    with other combinations by their hashes. The grid is numbered in mixed radix; no cross join.
    """
    sizes = {k: len(v) for k, v in grid.items()}
    full = int(np.prod(list(sizes.values())))
    stride, left = {}, full
    for k, n in sizes.items():
        left //= n
        stride[k] = left
    digit = {k: F.floor(F.col("trial") / stride[k]).cast("long") % n for k, n in sizes.items()}
    grid_ids = spark.range(full).withColumnRenamed("id", "trial")
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("trial").cast("string")))
    if budget < full:
        rng = np.random.default_rng(seed)
        turns = {k: rng.permutation(n) for k, n in sizes.items()}
        core = list(dict.fromkeys(sum(int(turns[k][i % n]) * stride[k] for k, n in sizes.items()) for i in range(min(budget, max(sizes.values())))))
        rest = grid_ids.filter(~F.col("trial").isin(core)).orderBy(place).limit(budget - len(core))
        grid_ids = grid_ids.filter(F.col("trial").isin(core)).unionByName(rest)
    return grid_ids.select("trial", *[F.element_at(F.array(*[F.lit(x) for x in v]), (digit[k] + 1).cast("int")).alias(k) for k, v in grid.items()])


def bounded_shares(df: DataFrame, by: str, arm: str, score: str, low: float, high: float) -> DataFrame:
    """Adds share: `low` for each arm plus what is left in proportion to the scores, at most `high`, the excess going to the other arms.

    The arms that stop at `high` are those of the largest scores, a prefix of that order. Without scores left the rest is shared evenly.
    """
    clean = df.withColumn("_s", F.when(F.col(score) > 0, F.col(score)).otherwise(0.0))
    order = Window.partitionBy(by).orderBy(F.col("_s").desc(), arm)
    every = Window.partitionBy(by)
    seen = clean.withColumns({"_n": F.count("*").over(every), "_k": F.row_number().over(order) - 1, "_rest": F.sum("_s").over(order.rowsBetween(0, Window.unboundedFollowing))})
    extra = high - low
    mass = 1 - low * F.col("_n") - F.col("_k") * extra
    step = F.when(F.col("_rest") > 0, mass / F.col("_rest"))
    # The first place in the order from which proportional sharing stays below the cap.
    first = F.min(F.when(F.coalesce(step * F.col("_s") <= extra + 1e-12, F.lit(True)), F.struct(F.col("_k").alias("k"), step.alias("step"), (mass / (F.col("_n") - F.col("_k"))).alias("even")))).over(every)
    ranked = seen.withColumn("_f", first)
    own = F.when(F.col("_k") < F.col("_f.k"), F.lit(extra)).otherwise(F.coalesce(F.col("_f.step") * F.col("_s"), F.col("_f.even")))
    return ranked.withColumn("share", F.lit(low) + F.least(own, F.lit(extra))).drop("_s", "_n", "_k", "_rest", "_f")


def thompson(arms: DataFrame, by: str, arm: str, wins: str, losses: str, seed: int = 0, low: float = 0.02, high: float = 0.7, prior: float = 1.0) -> DataFrame:
    """Per experiment one arm is picked: a Beta draw of each arm's record gives its share within bounds (see bounded_shares).

    Adds draw, share and picked; draws depend on seed, experiment and arm alone.
    """
    arms = arms.withColumn("_seed", F.xxhash64(F.lit(seed), F.col(by), F.col(arm)))
    kind = {f.name: f.dataType.simpleString() for f in arms.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, z, s = (b.column(b.schema.get_field_index(c)).to_pylist() for c in (wins, losses, "_seed"))
            drawn = [np.random.default_rng(n & (2**64 - 1)).beta(max(prior + (w or 0), 1e-9), max(prior + (x or 0), 1e-9)) for w, x, n in zip(a, z, s, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(drawn, pa.float64())], [*b.schema.names, "draw"])

    drawn = arms.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in kind.items()), "draw double"]))
    shared = bounded_shares(drawn.drop("_seed"), by, arm, "draw", low, high)
    through = F.sum("share").over(Window.partitionBy(by).orderBy(arm))
    # 52 bits of a hash: one number in [0, 1) an experiment.
    point = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(by).cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    before = through - F.col("share")
    last = F.row_number().over(Window.partitionBy(by).orderBy(F.col(arm).desc())) == 1
    return shared.withColumn("picked", (before <= point) & ((point < through) | last))


def pattern_relations(patterns: DataFrame, known: DataFrame | None = None, least: float = 0.92, keep: int = 1000) -> DataFrame:
    """patterns (key, family, side, centroid) -> (source, target, type, weight) of related pairs, source < target, less those in known.

    Same family: family_variant; else centroids at least `least` alike: near_duplicate, or opposite_side_placebo on other sides.
    Alike centroids have norms that differ by no more than their distance, so pairs meet by equal or neighbouring norm cells. The
    last `keep` relations by (source, target) stay.
    """
    size, zero = F.size("centroid"), F.lit(0.0)
    norm = F.sqrt(F.aggregate("centroid", zero, lambda s, x: s + x.cast("double") * x.cast("double")))
    reach = (1 / least - 1) * F.greatest(F.lit(1.0), F.sqrt(size))
    fine = F.forall("centroid", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    p = patterns.select("key", "family", "side", "centroid", size.alias("n"), F.when(F.coalesce(fine, F.lit(False)) & (size > 0), F.floor(norm / reach * (1 - 1e-9))).alias("cell"))
    side = lambda s: p.select(*[F.col(c).alias(f"{s}_{c}") for c in p.columns])
    one, two = side("a"), side("b")
    distance = F.sqrt(F.aggregate(F.zip_with("a_centroid", "b_centroid", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), zero, lambda s, d: s + d))
    alike = F.when((F.col("a_n") == F.col("b_n")) & F.col("a_cell").isNotNull() & F.col("b_cell").isNotNull(), 1 / (1 + distance / F.greatest(F.lit(1.0), F.sqrt("a_n")))).otherwise(0.0)
    family = one.join(two, (F.col("a_family") == F.col("b_family")) & (F.col("a_key") < F.col("b_key"))).withColumn("alike", alike)
    near = one.withColumn("cell", F.explode(F.array(F.col("a_cell") - 1, F.col("a_cell"), F.col("a_cell") + 1)))
    near = near.join(two, (F.col("cell") == F.col("b_cell")) & (F.col("a_n") == F.col("b_n")) & (F.col("a_key") < F.col("b_key")) & (F.col("a_family") != F.col("b_family"))).withColumn("alike", alike).filter(F.col("alike") >= least)
    ends = [F.col("a_key").alias("source"), F.col("b_key").alias("target")]
    out = family.select(*ends, F.lit("family_variant").alias("type"), F.greatest("alike", F.lit(0.75)).alias("weight")).unionByName(
        near.select(*ends, F.when(F.col("a_side") != F.col("b_side"), "opposite_side_placebo").otherwise("near_duplicate").alias("type"), F.col("alike").alias("weight"))
    )
    if known is not None:
        out = out.join(known.select("source", "target", "type"), ["source", "target", "type"], "left_anti")
    return out.orderBy(F.col("source").desc(), F.col("target").desc()).limit(keep)


def cup_backtest(bars: DataFrame, size: int = 60, hold: int = 30, stop: float = 0.92, reward: float = 3.0, most_gap: float = 0.08, cost_r: float = 0.0) -> DataFrame:
    """(symbol, date, skipped, outcome, r) of each cup that is acted on: entered at the next open, one trade at a time.

    A trade blocks `hold` bars; a cup whose next open is over `most_gap` away from its close, or beyond a barrier, is skipped and
    blocks none. Cups without `hold` bars after them are left out.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    path = X.forward_path(bars, hold).withColumn("_k", F.row_number().over(w)).filter(F.size("path") == hold)
    found = path.join(cups(bars, size).filter("found").select("symbol", "date"), ["symbol", "date"])
    level = F.col("close") * stop
    done = X.triple_barrier(found, "path", level, F.col("close") + (F.col("close") - level) * reward, hold)
    far = F.abs(F.col("entry") / F.col("close") - 1) > most_gap
    done = done.withColumn("skipped", far | (F.col("outcome") == "skip_gap"))
    done = done.withColumn("_end", F.when(F.col("skipped"), F.col("_k")).otherwise(F.col("_k") + hold - 1))
    done = done.withColumn("trade", F.struct("date", "skipped", F.when(~F.col("skipped"), F.col("outcome")).alias("outcome"), F.when(~F.col("skipped"), F.col("r") - cost_r).alias("r")))
    return non_overlapping(done, ["symbol"], "_k", "_end", "trade").select("symbol", "trade.*")


def compounded(trades: DataFrame, risk: float = 0.01, start: float = 3000.0) -> DataFrame:
    """Adds equity after each trade, symbol after symbol: growth within a symbol, times that of the symbols before (one row each)."""
    grown = trades.filter("not skipped and r is not null").withColumn("_g", F.log1p(F.greatest(risk * F.col("r"), F.lit(-0.999999))))
    totals = grown.groupBy("symbol").agg(F.sum("_g").alias("_t"))
    before = totals.withColumn("_b", F.coalesce(F.sum("_t").over(Window.orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("_t")
    inside = grown.withColumn("_in", F.sum("_g").over(Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    return inside.join(before, "symbol").withColumn("equity", start * F.exp(F.col("_in") + F.col("_b"))).drop("_g", "_in", "_b")
