"""What is wrong with a matrix of tests: repeated ids, broken rows, families or pairs that are missing, too many candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def problems(rows: DataFrame, key: str, checks: dict[str, Column], required: dict[str, list[str]], pairs: tuple[str, str, list[str], list[str]] | None, cap: tuple[Column, int] | None) -> DataFrame:
    """(problem, detail, n), none for a sound matrix.

    EMPTY; NO_ID (how many rows lack one); DUPLICATE (an id and how often it is there); each check's name, with the id of a row that it
    holds for; MISSING_<column> for a required value that no row has; MISSING_PAIR for a pair of values (first:second) that no row
    has; TOO_MANY rows that meet the cap's condition. Rows are counted once by what they are asked for, however many there are.
    """
    named = [*required, *(pairs[:2] if pairs else ())]
    if absent := [c for c in (key, *named) if c not in rows.columns]:
        raise ValueError(f"no columns {absent}")
    spark = rows.sparkSession
    told = lambda df, problem, detail, n: df.select(F.lit(problem).alias("problem"), detail.cast("string").alias("detail"), n.cast("long").alias("n"))
    over = F.count_if(cap[0]) if cap else F.lit(0)
    counts = rows.agg(F.count("*").alias("all"), F.count_if(F.col(key).isNull()).alias("nameless"), over.alias("over"))
    out = [told(counts.filter("all = 0"), "EMPTY", F.lit(""), F.lit(0)), told(counts.filter("nameless > 0"), "NO_ID", F.lit(""), F.col("nameless"))]
    if cap:
        out.append(told(counts.filter(F.col("over") > cap[1]), "TOO_MANY", F.lit(""), F.col("over")))
    ids = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    out.append(told(ids.filter("n > 1"), "DUPLICATE", F.col(key), F.col("n")))
    if checks:
        broken = rows.select(F.col(key), F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]))).alias("problem"))
        out.append(broken.groupBy("problem", key).agg(F.count("*").alias("n")).select("problem", F.coalesce(F.col(key).cast("string"), F.lit("")).alias("detail"), F.col("n").cast("long").alias("n")))
    for column, values in required.items():
        wanted = spark.createDataFrame([(v,) for v in values], f"`{column}` string")
        out.append(told(wanted.join(rows.select(F.col(column).cast("string").alias(column)).distinct(), column, "left_anti"), f"MISSING_{column}", F.col(column), F.lit(0)))
    if pairs:
        a, b, firsts, seconds = pairs
        wanted = spark.createDataFrame([(x, y) for x in firsts for y in seconds], f"`{a}` string, `{b}` string")
        seen = rows.select(F.col(a).cast("string").alias(a), F.col(b).cast("string").alias(b)).distinct()
        out.append(told(wanted.join(seen, [a, b], "left_anti"), "MISSING_PAIR", F.concat_ws(":", a, b), F.lit(0)))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole
