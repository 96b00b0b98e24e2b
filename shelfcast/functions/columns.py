"""Column expressions used by the feature jobs (P4-P7, P11, F5 bucket).

All are built-in Catalyst expressions, so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Score weights (five..one) and price-bucket cut points.
SCORE_WEIGHTS = (("scorefive", 5), ("scorefour", 4), ("scorethree", 3),
                 ("scoretwo", 2), ("scoreone", 1))
PRICE_CUTS = (3000.0, 2000.0, 1000.0)      # > 3000 → 3, > 2000 → 2, > 1000 → 1, else 0
STOCK_THRESHOLD = 3
MISSING = -999.0                           # what the cleansing step fills in for null numbers


def weighted_score(weights: Sequence[tuple[str, int]] = SCORE_WEIGHTS) -> Column:
    """5·five + 4·four + 3·three + 2·two + one, summed left to right."""
    total = None
    for name, weight in weights:
        term = F.col(name) if weight == 1 else F.col(name) * weight
        total = term if total is None else total + term
    return total


def price_bucket(price: Column | str = "price", cuts: Sequence[float] = PRICE_CUTS) -> Column:
    """P5: strict cut points from the top; null / sentinel prices fall to 0."""
    price = F.col(price) if isinstance(price, str) else price
    expr = None
    for level, cut in zip(range(len(cuts), 0, -1), cuts):
        cond = price > F.lit(cut)
        expr = F.when(cond, F.lit(float(level))) if expr is None else expr.when(cond, F.lit(float(level)))
    return expr.otherwise(F.lit(0.0)).cast("double")


def over_threshold(value: Column | str = "stock", threshold: float = STOCK_THRESHOLD) -> Column:
    """1.0 when value > threshold, else 0.0 (null → 0.0)."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value > F.lit(threshold), F.lit(1.0)).otherwise(F.lit(0.0)).cast("double")


def known(value: Column, inputs: Sequence[str], missing: str = "sentinel") -> Column:
    """``value`` as it is (``missing="sentinel"``), or null where an input is null or the fill sentinel
    """
    if missing == "sentinel":
        return value
    if missing != "null":
        raise ValueError(f"missing is 'sentinel' or 'null', not {missing!r}")
    present = [F.col(c).isNotNull() & (F.col(c) != F.lit(MISSING)) for c in inputs]
    return F.when(reduce(lambda a, b: a & b, present), value)


def with_scores(df: DataFrame, out: str = "scores", missing: str = "sentinel") -> DataFrame:
    """P4; with ``missing="null"`` a filled-in score gives no weighted score."""
    return df.withColumn(out, known(weighted_score(), [c for c, _ in SCORE_WEIGHTS], missing))


def with_relative_price(df: DataFrame, col: str = "price", out: str = "relativeprice",
                        cuts: Sequence[float] = PRICE_CUTS, missing: str = "sentinel") -> DataFrame:
    return df.withColumn(out, known(price_bucket(col, cuts), [col], missing))


def with_stock_flag(df: DataFrame, col: str = "stock", threshold: float = STOCK_THRESHOLD,
                    missing: str = "sentinel") -> DataFrame:
    """Overwrites ``col`` with its 0/1 flag, as the feature job does."""
    return df.withColumn(col, known(over_threshold(col, threshold), [col], missing))


def cast_label(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Label column to double."""
    return df.withColumn(out or col, F.col(col).cast("double"))


def log_label(df: DataFrame, col: str = "label", out: str = "loglabel") -> DataFrame:
    """Natural-log label transform."""
    return df.withColumn(out, F.log(F.col(col)))


def exp_prediction(df: DataFrame, col: str = "prediction", out: str = "expprediction") -> DataFrame:
    """Inverse of :func:`log_label` applied to predictions."""
    return df.withColumn(out, F.exp(F.col(col)))


def named_prediction(df: DataFrame, name: str, col: str = "prediction") -> DataFrame:
    """Keep only the prediction, renamed for side-by-side comparison."""
    return df.select(F.col(col).alias(name))


def key_bucket(keys: Sequence[str], buckets: int = 100, seed: int | None = None) -> Column:
    """Deterministic bucket in [0, buckets) from the md5 of the row key.

    Independent of partitioning and task order, so a recomputed partition
    (lost executor) lands every row in the same bucket again.  A ``seed``
    is prefixed to the key to draw a different, equally stable split.
    """
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    if seed is not None:
        parts = [F.lit(str(seed))] + parts
    key = F.concat_ws("|", *parts)
    head = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(buckets))


# Fixed quantization of compared doubles: step 1e-4, offset 0.3183.
QUANT_SCALE = 10000
QUANT_OFFSET = 0.3183


def quantize(col: Column | str) -> Column:
    """Cross-engine reporting rule: floor(x·10⁴ + 0.3183) / 10⁴.

    Aggregated doubles differ in their last bits between engines because
    summation order differs, so compared outputs are quantized.  With the
    usual +0.5 offset the step boundaries sit on exact 5th-decimal values,
    which means of 2-4-decimal prices hit often (an exact tie flips on the
    last bit).  Here a boundary is at fractional part 0.6817 of x·10⁴; as
    6817 is coprime to 10, a mean of k-decimal values (k ≤ 6) over fewer
    than 100 rows can never lie on it, so both engines land on the same
    step.
    """
    col = F.col(col) if isinstance(col, str) else col
    return F.floor(col * QUANT_SCALE + QUANT_OFFSET) / QUANT_SCALE


def quantize_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: quantize(c) for c in columns})
