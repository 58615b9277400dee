"""Factor formulas over features: values, rank correlation with the next return, selection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.formula import (
    POLARITY_SUFFIX,
    clean_formula,
    forbidden_call,
    formula_column,
    formula_problem,
)
from quotemill.functions.scalars import finite_or_null
from quotemill.operators.indicators import BASE_COLUMNS, FEATURES, forward_return
from quotemill.session import settle

NUMERIC = (*BASE_COLUMNS, *FEATURES)
FORMULAS_PER_STOCK = 5
MIN_SAMPLES = 10
# This many distinct formulas share one pass over the features, which bounds the size of its plan.
FORMULAS_A_PASS = 100


def checked_formulas(catalog: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """(stock_code, formula, expression, problem): problem is NULL for a usable formula.

    With ``features`` a polarity name is accepted only for the stock itself or one of its partners.
    """
    rows = catalog.select("stock_code", "formula").distinct().withColumn("expression", clean_formula("formula"))
    if features is None:
        return rows.withColumn("problem", formula_problem("expression", NUMERIC))
    named = features.select("stock_code", F.explode(F.map_keys("related_polarity")).alias("_code"))
    partners = named.groupBy("stock_code").agg(F.collect_set("_code").alias("_codes"))
    codes = F.array_append(F.coalesce("_codes", F.array().cast("array<string>")), F.lower("stock_code"))
    joined = rows.join(partners, "stock_code", "left")
    return joined.withColumn("problem", formula_problem("expression", NUMERIC, codes)).drop("_codes")


def _lookup(name: str) -> Column:
    if not name.lower().endswith(POLARITY_SUFFIX):
        return F.col(name).cast("double")
    code = name[: -len(POLARITY_SUFFIX)].lower()
    own = F.lower("stock_code") == code
    return F.when(own, F.col("polarity")).otherwise(F.try_element_at("related_polarity", F.lit(code)))


def apply_alphas(features: DataFrame, catalog: DataFrame) -> DataFrame:
    """Long table (stock_code, trade_date, formula, value) of each stock's own usable formulas.

    A value that is undefined or infinite is NULL. A row meets only its own stock's formulas, and
    computes each of them alone; the catalogue's distinct formulas are known to the driver.
    """
    good = checked_formulas(catalog, features).filter(F.col("problem").isNull()).drop("problem")
    expressions = sorted(r[0] for r in good.select("expression").distinct().collect())
    out = None
    for at in range(0, len(expressions), FORMULAS_A_PASS):
        part = _apply_some(features, good, expressions[at : at + FORMULAS_A_PASS])
        out = part if out is None else out.unionByName(part)
    if out is None:
        return features.sparkSession.createDataFrame(
            [], "stock_code string, trade_date date, formula string, value double"
        )
    return out


def _apply_some(features: DataFrame, good: DataFrame, expressions: list[str]) -> DataFrame:
    """Each stock's own among these formulas come as one short list, a row for each of them."""
    listed = good.filter(F.col("expression").isin(expressions))
    own = listed.groupBy("stock_code").agg(F.collect_set(F.struct("expression", "formula")).alias("_own"))
    rows = features.join(own, "stock_code").withColumn("_f", F.explode("_own"))
    value = F
    for expression in expressions:
        value = value.when(F.col("_f.expression") == expression, formula_column(expression, _lookup))
    return rows.select("stock_code", "trade_date", F.col("_f.formula").alias("formula"), finite_or_null(value).alias("value"))


def _tied_rank(over: list[str], value: str) -> Column:
    """Rank with ties sharing their average position."""
    by = Window.partitionBy(*over)
    return F.rank().over(by.orderBy(value)) + (F.count(F.lit(1)).over(by.partitionBy(*over, value)) - 1) / 2.0


def next_returns(features: DataFrame) -> DataFrame:
    return features.select("stock_code", "trade_date", forward_return(1).alias("future_return"))


def rank_ic(alphas: DataFrame, returns: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Rank correlation of each formula with the next return, its p-value and sample size.

    Too few samples or a constant side give NULL. A (stock, formula) group has one row per day, so
    its windows stay small; a stock's formulas are spread over tasks.
    """
    group = ["stock_code", "formula"]
    pairs = alphas.join(returns, ["stock_code", "trade_date"]).dropna(subset=["value", "future_return"])
    ranked = pairs.select(
        *group, _tied_rank(group, "value").alias("ra"), _tied_rank(group, "future_return").alias("rb")
    )
    n = F.count(F.lit(1))
    # corr would raise an error where one side is constant
    correlation = F.try_divide(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb"))
    scores = ranked.groupBy(*group).agg(
        F.when(
            (n >= min_samples) & correlation.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), correlation))
        ).alias("rank_ic"),
        F.when(n >= min_samples, n).otherwise(0).alias("n_samples"),
    )
    return scores.withColumn("pvalue", correlation_pvalue("rank_ic", "n_samples")).select(
        *group, "rank_ic", "pvalue", "n_samples"
    )


def correlation_pvalue(r: Column | str, n: Column | str) -> Column:
    """Two-sided p-value of a correlation ``r`` of ``n`` pairs; NULL without one or below 3 pairs.

    It is that of Student's t with n - 2 degrees of freedom, which for whole degrees is a finite sum:
    with x = 1 - r^2, P(|T| <= t) is |r| (1 + x/2 + 1*3/(2*4) x^2 + ..) for even ones, and
    2/pi (asin |r| + |r| sqrt(x) (1 + 2/3 x + 2*4/(3*5) x^2 + ..)) for odd ones.
    """
    r, n = (F.col(c) if isinstance(c, str) else c for c in (r, n))
    size, x = F.least(F.abs(r), F.lit(1.0)), F.greatest(1 - r * r, F.lit(0.0))
    odd = n % 2 == 1
    terms = F.floor((n - F.when(odd, 3).otherwise(2)) / 2).cast("int")  # none for 3 pairs
    shift = F.when(odd, 1).otherwise(0)
    step = lambda k: x * (2 * k - 1 + shift) / (2 * k + shift)
    total = F.aggregate(
        F.when(terms > 1, F.sequence(F.lit(1), terms - 1)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda acc, k: F.struct((acc["term"] * step(k)).alias("term"), (acc["total"] + acc["term"] * step(k)).alias("total")),
        lambda acc: acc["total"],
    )
    inside = F.when(odd, (F.asin(size) + F.when(terms > 0, size * F.sqrt(x) * total).otherwise(0.0)) * (2 / math.pi)).otherwise(size * total)
    known = r.isNotNull() & ~F.isnan(r) & (n >= 3)
    return F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - inside)))


def select_best_alphas(scores: DataFrame, k: int = FORMULAS_PER_STOCK) -> DataFrame:
    """The ``k`` formulas with the highest signed correlation, for stocks with at least ``k`` of them."""
    per_stock = Window.partitionBy("stock_code")
    position = F.row_number().over(per_stock.orderBy(F.col("rank_ic").desc_nulls_last(), "formula"))
    return (
        scores.withColumns({"position": position, "_n": F.count(F.lit(1)).over(per_stock)})
        .filter((F.col("position") <= k) & (F.col("_n") >= k))
        .drop("_n")
    )


def formula_pool(given: DataFrame, stored: DataFrame) -> DataFrame:
    """Given and stored formulas of each stock, each once."""
    old = stored.select("stock_code", F.col("alpha_formula").alias("formula"))
    return given.select("stock_code", "formula").unionByName(old).distinct()


def score_formulas(features: DataFrame, catalog: DataFrame) -> DataFrame:
    """Scores of every usable formula. Features are read several times, so they are settled first."""
    features = settle(features)
    return rank_ic(apply_alphas(features, catalog), next_returns(features))


def alpha_metrics(best: DataFrame, day: str) -> DataFrame:
    """Rows of the stored formula table for the selected formulas."""
    return best.select(
        "stock_code",
        F.col("formula").alias("alpha_formula"),
        "rank_ic",
        "pvalue",
        "n_samples",
        F.lit(day).alias("date_calculated"),
    )


def audit_formulas(catalog: DataFrame) -> DataFrame:
    """(stock_code, issue, detail) for stocks without exactly five formulas, refused calls, empty text."""
    counts = catalog.groupBy("stock_code").agg(F.count(F.lit(1)).alias("n"))
    wrong = counts.filter(F.col("n") != FORMULAS_PER_STOCK).select(
        "stock_code", F.lit("wrong number of formulas").alias("issue"), F.col("n").cast("string").alias("detail")
    )
    text = F.trim(F.coalesce("formula", F.lit("")))
    issue = F.when(text == "", "empty").when(forbidden_call(text).isNotNull(), "forbidden call")
    bad = catalog.select("stock_code", issue.alias("issue"), text.alias("detail")).filter(F.col("issue").isNotNull())
    return wrong.unionByName(bad)
