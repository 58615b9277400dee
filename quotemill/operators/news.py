"""News: sentiment per day, company mentions, sectors, lists and pages, scoring."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.scalars import sector_label, strip_suffix

WORD_BREAK = r"[^\p{L}\p{N}_]+"
# Narrow key tables up to this many rows are broadcast, larger ones are shuffled.
BROADCAST_KEYS = 200_000


def sized_broadcast(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast a narrow table after counting that it has at most ``limit`` rows; else leave it."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def daily_sentiment(news: DataFrame) -> DataFrame:
    return news.groupBy("stock_code", F.col("news_date").alias("trade_date")).agg(
        F.avg("sentiment_score").alias("polarity")
    )


def words(text: Column | str) -> Column:
    """The distinct lower-case words of a text."""
    return F.array_distinct(F.split(F.lower(text), WORD_BREAK))


def mention_pairs(news: DataFrame, dim: DataFrame) -> DataFrame:
    """(article_id, stock_code, mentioned): each known code that stands in the text as a whole word.

    Texts are cut into words once and the words are looked up, instead of searching every code in
    every text.
    """
    codes = dim.select(F.lower("stock_code").alias("word"), F.col("stock_code").alias("mentioned")).distinct()
    tokens = news.select("article_id", "stock_code", F.explode(words("content")).alias("word"))
    return tokens.join(sized_broadcast(codes, BROADCAST_KEYS), "word").select("article_id", "stock_code", "mentioned")


def related_companies(news: DataFrame, dim: DataFrame, k: int = 5, end_date: str | None = None) -> DataFrame:
    """The ``k`` codes most often named in a stock's own articles that name the stock too.

    Only (own code, other code) pairs are formed, never all pairs of an article. Ties go to the
    smaller code. ``end_date`` keeps later articles out.
    """
    rows = news if end_date is None else news.filter(F.col("news_date") < F.lit(end_date).cast("date"))
    codes = dim.select(F.lower("stock_code").alias("word"), F.col("stock_code").alias("mentioned")).distinct()
    tokens = rows.select(
        "article_id", F.col("stock_code"), words("content").alias("words")
    ).filter(F.array_contains("words", F.lower("stock_code")))
    pairs = (
        tokens.select("article_id", "stock_code", F.explode("words").alias("word"))
        .join(sized_broadcast(codes, BROADCAST_KEYS), "word")
        .filter(F.lower("mentioned") != F.lower("stock_code"))
    )
    counts = pairs.groupBy("stock_code", F.col("mentioned").alias("partner")).agg(F.count(F.lit(1)).alias("n_articles"))
    rank = F.row_number().over(Window.partitionBy("stock_code").orderBy(F.desc("n_articles"), "partner"))
    return counts.withColumn("position", rank).filter(F.col("position") <= k)


def with_sector(df: DataFrame, sectors: DataFrame, column: str = "stock_code", how: str = "inner") -> DataFrame:
    """Attach the sector of a code; ``sectors`` is the small (stock_code, sector) table."""
    return df.join(sectors.select(F.col("stock_code").alias(column), "sector"), column, how)


def sector_counts(news: DataFrame, sectors: DataFrame) -> DataFrame:
    """Codes with news per sector, and all codes together as sector ``all``."""
    codes = news.select(F.upper(strip_suffix("stock_code")).alias("stock_code")).distinct()
    per_sector = with_sector(codes, sectors).groupBy("sector").agg(F.count(F.lit(1)).alias("n_codes"))
    total = codes.agg(F.count(F.lit(1)).alias("n_codes")).select(F.lit("all").alias("sector"), "n_codes")
    return total.unionByName(per_sector).select("sector", sector_label("sector").alias("label"), "n_codes")


def news_by_sector(news: DataFrame, sectors: DataFrame, k: int = 5) -> DataFrame:
    """Articles per sector with share and the ``k`` codes with most articles in each.

    ``n_news`` counts all articles, also those of codes without a sector.
    """
    per_code = news.groupBy("stock_code").agg(F.count(F.lit(1)).alias("n_articles"))
    everything = per_code.agg(F.sum("n_articles").alias("n_news"))
    mapped = with_sector(per_code, sectors)
    in_sector = Window.partitionBy("sector")
    rank = F.row_number().over(in_sector.orderBy(F.desc("n_articles"), "stock_code"))
    ranked = mapped.withColumns(
        {"sector_total": F.sum("n_articles").over(in_sector), "position": rank}
    ).filter(F.col("position") <= k)
    return (
        ranked.join(F.broadcast(everything))  # one row
        .withColumn("share_percent", F.try_divide(F.col("sector_total") * 100.0, F.col("n_news")))
        .select("sector", "sector_total", "share_percent", "n_news", "stock_code", "n_articles", "position")
        .orderBy(F.desc("sector_total"), "sector", "position")
    )


def recent_news(news: DataFrame, now: dt.datetime, days: int = 3, k: int = 5) -> DataFrame:
    since = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))
    return news.filter(F.col("date") >= since).orderBy(F.desc("date"), "stock_code", "article_id").limit(k)


def news_by_symbol(news: DataFrame, code: str) -> DataFrame:
    return news.filter(F.col("stock_code") == code)


def sort_news(news: DataFrame, date: str = "date") -> DataFrame:
    """Newest first; text dates in day-month-year order are read too, unreadable ones come last."""
    value = F.col(date)
    if dict(news.dtypes)[date] == "string":
        value = F.coalesce(
            F.try_to_timestamp(value, F.lit("dd-MM-yyyy HH:mm:ssXX")), F.try_to_timestamp(value, F.lit("dd-MM-yyyy"))
        )
    return news.orderBy(value.desc_nulls_last(), "article_id")


def page(df: DataFrame, n: int, order: list[Column | str], size: int = 20) -> DataFrame:
    """The ``n``-th page (from 1) of the rows in a total order, with the number of pages."""
    pages = df.agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("bigint").alias("total_pages"))
    rows = df.orderBy(*order).offset((n - 1) * size).limit(size)
    return rows.join(F.broadcast(pages))  # one row


# --- sentiment ----------------------------------------------------------------------------------

# A small default word list; callers pass their own lists or a model.
GOOD_WORDS = ("profit", "growth", "gain", "rise", "record", "strong", "up")
BAD_WORDS = ("loss", "decline", "fall", "drop", "weak", "debt", "down")


def word_score(text: Column | str, good: tuple[str, ...] = GOOD_WORDS, bad: tuple[str, ...] = BAD_WORDS) -> Column:
    """(good - bad) / (good + bad) over the words of a text, 0 without any of them."""
    tokens = F.split(F.lower(text), WORD_BREAK)
    n_good = F.size(F.filter(tokens, lambda w: w.isin(*good)))
    n_bad = F.size(F.filter(tokens, lambda w: w.isin(*bad)))
    return F.coalesce(F.try_divide((n_good - n_bad).cast("double"), (n_good + n_bad).cast("double")), F.lit(0.0))


def score_articles(
    news: DataFrame,
    text_scorer: Callable[..., pd.Series] | None = None,
    pdf_scorer: Callable[..., pd.Series] | None = None,
    chars: int | None = None,
    code_col: str | None = None,
    pdfs: DataFrame | None = None,
    good: tuple[str, ...] = GOOD_WORDS,
    bad: tuple[str, ...] = BAD_WORDS,
) -> DataFrame:
    """Add ``sentiment_score`` in -1..1. Per row: what its PDF says, else its text, else 0.

    A text scorer sees the whole content, or its first ``chars`` characters where a model takes no
    more; without one the word lists decide. A PDF scorer sees the link, or where ``pdfs`` (path,
    content, as ``binaryFile`` reads them) is given the bytes of the file the link names; a PDF that
    has no file, or that the scorer fails on, goes by its text. Scorers are vectorised functions;
    with ``code_col`` they are given the stock's code as a second series, to score for that stock.
    """
    text = F.coalesce("content", F.lit(""))
    text = text if chars is None else F.substring(text, 1, chars)
    is_pdf = F.coalesce("is_pdf", F.lit(False))
    link, rows = F.coalesce("pdf_link", "link"), news
    if pdfs is not None:
        files = pdfs.select(F.col("path").alias("_path"), F.col("content").alias("_bytes"))
        rows = news.withColumn("_link", F.when(is_pdf, link)).join(files, F.col("_link") == F.col("_path"), "left")
    code = F.lit(None).cast("string") if code_col is None else F.col(code_col)
    # Spark runs Python functions on all rows, so each scorer is given NULL for those it has no say in
    seen = F.lit(None).cast("double")
    if pdf_scorer is not None:
        what = F.when(is_pdf, link if pdfs is None else F.col("_bytes"))
        kept = [*news.columns, "_pdf_score"]
        rows = rows.withColumn("_pdf_score", F.nanvl(_guarded(pdf_scorer, code_col is not None)(what, code), F.lit(None).cast("double"))).select(kept)
        seen = F.col("_pdf_score")
    by_text = word_score(text, good, bad) if text_scorer is None else _guarded(text_scorer, code_col is not None)(F.when(seen.isNull(), text), code)
    score = F.coalesce(seen, F.nanvl(by_text, F.lit(None).cast("double")), F.lit(0.0))
    scored = rows.withColumn("sentiment_score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)))
    return scored.select(*[c for c in news.columns if c != "sentiment_score"], "sentiment_score")


def _guarded(scorer: Callable[..., pd.Series], with_code: bool):
    """The scorer on all rows that aren't NULL.

    A batch that it cannot handle is tried row by row, so one bad row costs only itself.
    """

    def scores(values: pd.Series, codes: pd.Series) -> pd.Series:
        return scorer(values, codes) if with_code else scorer(values)

    def one(value, code) -> float:
        try:
            return float(scores(pd.Series([value]), pd.Series([code])).iloc[0])
        except Exception:
            return float("nan")

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for values, codes in batches:
            out, own = pd.Series(float("nan"), values.index), values[values.notna()]
            if len(own):
                try:
                    out[own.index] = scores(own, codes[own.index]).astype("float64").to_numpy()
                except Exception:
                    out[own.index] = [one(v, c) for v, c in zip(own, codes[own.index])]
            yield out

    return run
