"""Next-close prediction and its evaluation.

Bars and features hold one row per stock and date, so windows per stock are bounded by the days of
the history.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.functions.calendar import calendar_features, next_weekday
from quotemill.functions.scalars import confidence, is_finite, trend, trend_sign
from quotemill.operators.joins import join_actuals
from quotemill.sources.files import read_model_runs

WINDOW = 5
MIN_WINDOWS = 50
TRAIN_SHARE = 0.8
CALENDAR = ("day", "week", "month")


def by_stock():
    return Window.partitionBy("stock_code").orderBy("trade_date")


# --- shaping ------------------------------------------------------------------------------------


def tail_by_key(df: DataFrame, n: int, key: str = "stock_code", order: Sequence[str] = ("trade_date",)) -> DataFrame:
    """The last ``n`` rows per key. Spark drops all but ``n`` rows of a key before the shuffle."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_from_end", F.row_number().over(newest)).filter(F.col("_from_end") <= n).drop("_from_end")


def period_summary(bars: DataFrame, n: int) -> DataFrame:
    """Highest high, lowest low and mean volume over the last ``n`` bars of each stock."""
    return tail_by_key(bars, n).groupBy("stock_code").agg(
        F.max("high").alias("highest"), F.min("low").alias("lowest"), F.avg("volume").alias("avg_volume")
    )


def minmax_fit(df: DataFrame, columns: Sequence[str], key: str = "stock_code") -> DataFrame:
    return df.groupBy(key).agg(
        *[F.min(c).alias(f"{c}_min") for c in columns], *[F.max(c).alias(f"{c}_max") for c in columns]
    )


def _span(c: str) -> Column:
    wide = F.col(f"{c}_max") - F.col(f"{c}_min")
    return F.when(wide == 0, 1.0).otherwise(wide)


def minmax_apply(df: DataFrame, fitted: DataFrame, columns: Sequence[str], key: str = "stock_code", keep: bool = False) -> DataFrame:
    """Scale columns to 0..1 of the fitted range into ``<name>_scaled``; a constant column gives 0."""
    joined = df.join(fitted, key)
    out = joined.withColumns({f"{c}_scaled": (F.col(c) - F.col(f"{c}_min")) / _span(c) for c in columns})
    return out if keep else out.drop(*[f"{c}_{e}" for c in columns for e in ("min", "max")])


def minmax_invert(df: DataFrame, fitted: DataFrame, scaled: str, column: str, out: str, key: str = "stock_code") -> DataFrame:
    ends = fitted.select(key, f"{column}_min", f"{column}_max")
    value = F.col(scaled) * _span(column) + F.col(f"{column}_min")
    return df.join(ends, key).withColumn(out, value).drop(f"{column}_min", f"{column}_max")


def sequences(df: DataFrame, inputs: Sequence[str], close: str = "close", w: int = WINDOW) -> DataFrame:
    """Sliding windows of ``w`` rows per stock with the next close as the target.

    Each row carries the window's inputs, closes and calendar columns, oldest first, the first and
    last date, and the target with its date. A stock of n rows gives n - w windows.
    """
    frame = by_stock().rowsBetween(0, w - 1)
    row = F.struct(
        F.col("trade_date").alias("d"),
        F.array(*[F.col(c).cast("double") for c in inputs]).alias("x"),
        F.col(close).cast("double").alias("c"),
        F.array(*[F.col(c).cast("double") for c in CALENDAR]).alias("t"),
    )
    windows = calendar_features(df).select(
        "stock_code",
        F.collect_list(row).over(frame).alias("_rows"),
        F.lead(close, w).over(by_stock()).alias("target"),
        F.lead("trade_date", w).over(by_stock()).alias("target_date"),
    )
    return windows.filter((F.size("_rows") == w) & F.col("target_date").isNotNull()).select(
        "stock_code",
        F.col("_rows")[0]["d"].alias("first_date"),
        F.col("_rows")[w - 1]["d"].alias("last_date"),
        F.col("_rows.x").alias("inputs"),
        F.col("_rows.c").alias("closes"),
        F.col("_rows.t").alias("calendar"),
        "target",
        "target_date",
    )


def last_windows(df: DataFrame, inputs: Sequence[str], close: str = "close", w: int = WINDOW) -> DataFrame:
    """The newest ``w`` rows of each stock as one window, for stocks with that many rows."""
    row = F.struct(
        F.col("trade_date").alias("d"),
        F.array(*[F.col(c).cast("double") for c in inputs]).alias("x"),
        F.col(close).cast("double").alias("c"),
        F.array(*[F.col(c).cast("double") for c in CALENDAR]).alias("t"),
    )
    tail = calendar_features(tail_by_key(df, w))
    rows = tail.groupBy("stock_code").agg(F.array_sort(F.collect_list(row)).alias("_rows"))  # w rows
    return rows.filter(F.size("_rows") == w).select(
        "stock_code",
        F.col("_rows")[w - 1]["d"].alias("last_date"),
        F.col("_rows.x").alias("inputs"),
        F.col("_rows.c").alias("closes"),
        F.col("_rows.t").alias("calendar"),
    )


# --- training -----------------------------------------------------------------------------------


@dataclass
class Trained:
    """Candidate models, their validation per stock, and the scaling they were trained with."""

    models: dict[str, Transformer | PipelineModel]
    validation: DataFrame
    scaling: DataFrame
    inputs: tuple[str, ...]

    def best(self) -> DataFrame:
        """The candidate with the lowest error per stock."""
        choice = F.min_by(F.struct("model_type", "mse_loss", "n_windows"), F.struct("mse_loss", "model_type"))
        return self.validation.groupBy("stock_code").agg(choice.alias("b")).select("stock_code", "b.*")


def split_date(df: DataFrame, share: float = TRAIN_SHARE) -> DataFrame:
    """Per stock the date at which the first ``share`` of its rows ends."""
    ranked = df.select("stock_code", "trade_date", F.cume_dist().over(by_stock()).alias("_share"))
    return ranked.filter(F.col("_share") <= share).groupBy("stock_code").agg(F.max("trade_date").alias("cut"))


def _vectors(windows: DataFrame) -> DataFrame:
    flat = F.concat(F.flatten("inputs"), F.col("closes"), F.element_at("calendar", -1))
    return windows.withColumn("features", array_to_vector(flat))


def gram_sums(rows: DataFrame, x: str = "features", y: str = "target", key: str = "stock_code") -> DataFrame:
    """Per stock the sums of products of the features, a constant 1 and the target, as one flat list.

    Sums are made entry by entry, before the shuffle where they can be; what is left of a stock is
    (p + 2) squared numbers for p features, whatever its history.
    """
    extended = F.concat(F.col(x), F.array(F.lit(1.0)), F.array(F.col(y).cast("double")))
    rows = rows.select(key, extended.alias("_v"))
    left = rows.select(key, "_v", F.posexplode("_v").alias("_i", "_a"))
    entries = left.select(key, "_i", F.posexplode(F.transform("_v", lambda b: b * F.col("_a"))).alias("_j", "_ab"))
    sums = entries.groupBy(key, "_i", "_j").agg(F.sum("_ab").alias("_s"))
    cells = F.array_sort(F.collect_list(F.struct("_i", "_j", "_s")))
    return sums.groupBy(key).agg(cells.alias("_cells")).select(key, F.col("_cells._s").alias("gram"))


def _solve(gram: pd.Series, ridge: pd.Series) -> pd.Series:
    def weights(flat, penalty):
        size = math.isqrt(len(flat))
        g = np.asarray(flat, dtype=float).reshape(size, size)
        inner = g[:-1, :-1] + np.diag([*[penalty] * (size - 2), 0.0])
        # the smallest weights where features depend on each other
        return np.linalg.lstsq(inner, g[:-1, -1], rcond=None)[0].tolist()

    return pd.Series([weights(g, p) for g, p in zip(gram, ridge)])


def least_squares(rows: DataFrame, x: str = "features", y: str = "target", ridge: float = 0.0, key: str = "stock_code") -> DataFrame:
    """(stock, weights): the linear fit of each stock on its own, the intercept last.

    ``ridge`` times the number of rows is added to the diagonal, but for the intercept. Rows with
    NULL or non-finite values should be left out before.
    """
    sums = gram_sums(rows, x, y, key)
    n = F.element_at("gram", -(F.sqrt(F.size("gram")).cast("int") + 2))  # the sum of 1 x 1
    solve = F.pandas_udf(_solve, T.ArrayType(T.DoubleType()))
    return sums.select(key, solve("gram", F.lit(ridge) * n).alias("weights"))


def linear_value(weights: Column | str, x: Column | str) -> Column:
    """The fitted value: features times weights, summed in order, and the intercept."""
    w = F.col(weights) if isinstance(weights, str) else weights
    v = F.col(x) if isinstance(x, str) else x
    products = F.zip_with(F.concat(v, F.array(F.lit(1.0))), w, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def linear_validation(
    df: DataFrame, inputs: Sequence[str], close: str = "close", w: int = WINDOW, min_windows: int = MIN_WINDOWS, ridge: float = 0.0
) -> tuple[DataFrame, DataFrame]:
    """A least-squares fit of each stock's next close, and what it gives on the later windows.

    Split, scaling and windows are those of ``train_and_validate``, with the closes and ``inputs``
    of the window as features. First: (stock_code, target_date, target, predicted) in prices, for
    the validation windows. Second: (stock_code, mse_loss, n_windows, weights), the error in scaled
    units.
    """
    columns = [*inputs, close]
    cut = split_date(df)
    fit_rows = df.join(cut, "stock_code").filter(F.col("trade_date") <= F.col("cut"))
    scaling = minmax_fit(fit_rows, columns)
    scaled = minmax_apply(df, scaling, columns)
    windows = sequences(scaled, [f"{c}_scaled" for c in inputs], f"{close}_scaled", w)
    sizes = windows.groupBy("stock_code").agg(F.count(F.lit(1)).alias("n_windows")).filter(F.col("n_windows") >= min_windows)
    flat = F.concat(F.flatten("inputs"), "closes")
    data = windows.withColumn("features", flat).join(sizes, "stock_code").join(cut, "stock_code")
    fitted = least_squares(data.filter(F.col("target_date") <= F.col("cut")), ridge=ridge)
    later = data.filter(F.col("target_date") > F.col("cut")).join(fitted, "stock_code")
    later = later.withColumn("scaled", linear_value("weights", "features"))
    loss = later.groupBy("stock_code").agg(
        F.avg(F.pow(F.col("scaled") - F.col("target"), 2)).alias("mse_loss"),
        F.max("n_windows").alias("n_windows"),
        F.first("weights").alias("weights"),
    )
    prices = minmax_invert(later, scaling, "scaled", close, "predicted")
    prices = minmax_invert(prices, scaling, "target", close, "_price").drop("target").withColumnRenamed("_price", "target")
    return prices.select("stock_code", "target_date", "target", "predicted"), loss


def train_and_validate(
    df: DataFrame,
    inputs: Sequence[str],
    w: int = WINDOW,
    min_windows: int = MIN_WINDOWS,
    fit_on_all: bool = False,
    seed: int = 7,
    trees: int = 20,
) -> Trained:
    """Train two regressors over all stocks together and measure each stock's validation error.

    The split is by time: the first 80 % of a stock's windows train, the rest validate. Scaling is
    fitted on the training rows; ``fit_on_all`` fits it on all rows. Stocks with fewer than
    ``min_windows`` windows are left out.
    """
    columns = [*inputs, "close"]
    cut = split_date(df)
    fit_rows = df if fit_on_all else df.join(cut, "stock_code").filter(F.col("trade_date") <= F.col("cut"))
    scaling = minmax_fit(fit_rows, columns).persist()
    scaled = minmax_apply(df, scaling, columns)
    windows = sequences(scaled, [f"{c}_scaled" for c in inputs], "close_scaled", w)
    sizes = windows.groupBy("stock_code").agg(F.count(F.lit(1)).alias("n_windows"))
    enough = sizes.filter(F.col("n_windows") >= min_windows)
    data = (
        _vectors(windows)
        .join(enough, "stock_code")
        .join(cut, "stock_code")
        .select("stock_code", "n_windows", "features", "target", (F.col("target_date") <= F.col("cut")).alias("train"))
        .persist()
    )
    candidates = {
        "Linear": LinearRegression(featuresCol="features", labelCol="target", regParam=1e-4),
        "Trees": GBTRegressor(featuresCol="features", labelCol="target", maxIter=trees, maxDepth=4, seed=seed),
    }
    models = {name: c.fit(data.filter("train")) for name, c in candidates.items()}
    error = None
    for name, model in models.items():
        rows = model.transform(data.filter("NOT train"))
        part = rows.groupBy("stock_code").agg(
            F.avg(F.pow(F.col("prediction") - F.col("target"), 2)).alias("mse_loss"),
            F.max("n_windows").alias("n_windows"),
        )
        part = part.withColumn("model_type", F.lit(name))
        error = part if error is None else error.unionByName(part)
    return Trained(models, error, scaling, tuple(inputs))


def model_name(code: Column | str, stamp: Column | str, kind: Column | str) -> Column:
    code, stamp, kind = (F.col(c) if isinstance(c, str) else c for c in (code, stamp, kind))
    return F.concat_ws("_", F.lit("StockModel"), code, stamp, kind)


def champion(new: DataFrame, yesterday: DataFrame) -> DataFrame:
    """The new model of each stock, or yesterday's where its loss is lower."""
    old = yesterday.select(
        "stock_code", F.col("model_name").alias("_old_name"), F.col("mse_loss").alias("_old_loss")
    )
    keep = F.col("_old_loss") < F.col("mse_loss")
    joined = new.join(old, "stock_code", "left").withColumn("new_model_used", ~F.coalesce(keep, F.lit(False)))
    return joined.select(
        "stock_code",
        F.when(F.col("new_model_used"), F.col("model_name")).otherwise(F.col("_old_name")).alias("model_name"),
        F.when(F.col("new_model_used"), F.col("mse_loss")).otherwise(F.col("_old_loss")).alias("mse_loss"),
        "new_model_used",
    ).withColumn("confidence", confidence("mse_loss"))


def predict_next_close(trained: Trained, df: DataFrame, chosen: DataFrame, w: int = WINDOW) -> DataFrame:
    """(stock_code, last_date, predicted_price) from each stock's newest window and chosen model."""
    scaled = minmax_apply(df, trained.scaling, [*trained.inputs, "close"])
    windows = _vectors(last_windows(scaled, [f"{c}_scaled" for c in trained.inputs], "close_scaled", w))
    windows = windows.join(chosen.select("stock_code", "model_type"), "stock_code")
    out = None
    for name, model in trained.models.items():
        part = model.transform(windows.filter(F.col("model_type") == name)).select(
            "stock_code", "last_date", "model_type", F.col("prediction").alias("_scaled")
        )
        out = part if out is None else out.unionByName(part)
    return minmax_invert(out, trained.scaling, "_scaled", "close", "predicted_price").drop("_scaled")


def saveable(predictions: DataFrame) -> DataFrame:
    """Only predictions with a finite price and confidence."""
    return predictions.filter(is_finite("predicted_price") & is_finite("confidence_score"))


# --- evaluation ---------------------------------------------------------------------------------


def prediction_accuracy(predictions: DataFrame, daily: DataFrame) -> DataFrame:
    """Share of predictions that named the right direction, per stock."""
    rows = join_actuals(predictions, daily)
    hit = trend("predicted_price", "prev_close") == trend("actual_close", "prev_close")
    out = rows.groupBy("stock_code").agg(F.count_if(hit).alias("correct"), F.count(F.lit(1)).alias("total"))
    percent = F.col("correct") / F.col("total") * 100
    return out.withColumn("accuracy", F.bround(percent, 2)).orderBy("stock_code")


def prediction_history(predictions: DataFrame, daily: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` bars of each stock: actual and predicted direction and whether they agree.

    A bar without the close of the weekday before is skipped. Without a prediction the direction is
    neutral and the hit is NULL.
    """
    recent = tail_by_key(daily, n).select("stock_code", F.col("trade_date").alias("prediction_date"))
    rows = join_actuals(recent, daily, "left").filter(F.coalesce("prev_close", F.lit(0.0)) != 0)
    guess = predictions.select("stock_code", "prediction_date", "predicted_price")
    rows = rows.join(guess, ["stock_code", "prediction_date"], "left")
    predicted = F.when(F.col("predicted_price").isNotNull(), trend_sign("predicted_price", "prev_close")).otherwise(0)
    actual = trend_sign("actual_close", "prev_close")
    return rows.select(
        "stock_code",
        "prediction_date",
        predicted.alias("predicted_value"),
        actual.alias("actual_value"),
        F.when(F.col("predicted_price").isNotNull(), predicted == actual).alias("is_correct"),
    )


def next_day_outlook(predictions: DataFrame, daily: DataFrame) -> DataFrame:
    """Direction predicted for the weekday after the newest bar; NULL without such a prediction."""
    newest = daily.groupBy("stock_code").agg(
        F.max("trade_date").alias("last_date"), F.max_by("close", "trade_date").alias("last_close")
    )
    rows = newest.withColumn("prediction_date", next_weekday("last_date"))
    guess = predictions.select("stock_code", "prediction_date", "predicted_price")
    joined = rows.join(guess, ["stock_code", "prediction_date"], "left")
    return joined.withColumn(
        "trend", F.when(F.col("predicted_price").isNotNull(), trend("predicted_price", "last_close"))
    )


def latest_predictions(predictions: DataFrame) -> DataFrame:
    """The newest prediction per stock."""
    row = F.max_by(F.struct("prediction_date", "predicted_price", "confidence_score"), "prediction_date")
    return predictions.groupBy("stock_code").agg(row.alias("p")).select("stock_code", "p.*")


def predictions_history(predictions: DataFrame, symbol: str | None = None) -> DataFrame:
    rows = predictions if symbol is None else predictions.filter(F.col("stock_code") == symbol)
    return rows.select("stock_code", "prediction_date", "predicted_price", "confidence_score").orderBy(
        "stock_code", F.desc("prediction_date")
    )


def best_model(runs: DataFrame, symbol: str | None = None, day: str | None = None) -> DataFrame:
    """The run with the lowest loss per stock and day."""
    rows = read_model_runs(runs)
    if symbol is not None:
        rows = rows.filter(F.col("stock_code") == symbol)
    if day is not None:
        rows = rows.filter(F.col("trained_on") == F.lit(day).cast("date"))
    run = F.min_by(F.struct("model_name", "mse_loss", "alphas"), F.struct("mse_loss", "model_name"))
    return rows.groupBy("stock_code", "trained_on").agg(run.alias("r")).select("stock_code", "trained_on", "r.*")


def training_history(runs: DataFrame, name: str | None = None) -> DataFrame:
    """Runs, newest first by true date; ``name`` keeps one model."""
    rows = read_model_runs(runs)
    if name is not None:
        rows = rows.filter(F.col("model_name") == name)
    return rows.orderBy(F.desc("trained_on"), "model_name")


def run_summary(results: DataFrame) -> DataFrame:
    failed = F.count_if(F.col("error").isNotNull())
    total = F.count(F.lit(1))
    return results.agg(total.alias("total"), (total - failed).alias("success"), failed.alias("failed"))


