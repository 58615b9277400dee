"""Readers and writers for ticks, CSV feeds, JSON catalogues and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill import schemas
from quotemill.functions.scalars import decode_list, parse_bool, parse_tick_ts, parse_ts_multi


def read_ticks(
    spark: SparkSession,
    path: str,
    streaming: bool = False,
    fmt: str = "parquet",
    schema: T.StructType = schemas.TICK,
    **options,
) -> DataFrame:
    """Ticks with the declared schema, as a batch or as a stream over a growing folder.

    ``fmt="kafka"`` reads JSON messages from a topic where the cluster carries that connector.
    """
    reader = spark.readStream if streaming else spark.read
    if fmt == "kafka":
        raw = reader.format("kafka").options(**options).option("subscribe", path).load()
        return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("t")).select("t.*")
    return reader.schema(schema).format(fmt).options(**options).load(path)


def with_event_time(ticks: DataFrame) -> DataFrame:
    """Add the parsed time and a tie breaker. Text that is no time leaves ``event_ts`` NULL."""
    found = {"event_ts": parse_tick_ts("timestamp"), "seq": F.col("producer_timestamp")}
    return ticks.withColumns({name: value for name, value in found.items() if name not in ticks.columns})


def split_unparsed(ticks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ticks with a time, and the rejected rest."""
    timed = with_event_time(ticks)
    return timed.filter(F.col("event_ts").isNotNull()), timed.filter(F.col("event_ts").isNull())


def normalize_quotes(quotes: DataFrame, produced_at: Column | None = None) -> DataFrame:
    """Raw quotes to ticks: id to symbol, defaults for missing fields, casts, producer time."""
    have = set(quotes.columns)

    def field(name: str, kind: str, default) -> Column:
        value = F.col(name).try_cast(kind) if name in have else F.lit(None).cast(kind)
        return F.coalesce(value, F.lit(default).cast(kind))

    stamp = produced_at if produced_at is not None else F.unix_millis(F.current_timestamp())
    return quotes.select(
        field("id", "string", "").alias("symbol"),
        field("price", "double", 0.0).alias("price"),
        field("time", "string", "").alias("timestamp"),
        field("exchange", "string", "").alias("exchange"),
        field("quote_type", "int", 0).alias("quote_type"),
        field("market_hours", "int", 0).alias("market_hours"),
        field("change_percent", "double", 0.0).alias("change_percent"),
        field("day_volume", "bigint", 0).alias("day_volume"),
        field("change", "double", 0.0).alias("change"),
        field("last_size", "bigint", 0).alias("last_size"),
        field("price_hint", "string", "").alias("price_hint"),
        stamp.cast("bigint").alias("producer_timestamp"),
    )


LINE = "_line"


def _read_text_csv(spark: SparkSession, path: str, columns: Sequence[str], multi_line: bool) -> DataFrame:
    """CSV with a header as text columns, very long fields included, and ``_line`` where it is broken.

    With ``multi_line`` quoted line breaks are kept, and a file is one task's. Otherwise a row is a
    line and large files are split; a line with an open quote or with too many fields is broken.
    """
    text = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, LINE)])
    rows = spark.read.csv(
        path, schema=text, header=True, multiLine=multi_line, escape='"', maxCharsPerColumn=-1, mode="PERMISSIVE",
        columnNameOfCorruptRecord=LINE,
    )
    # a line that only ends early has NULL in its last columns
    short = ~F.contains(LINE, F.lit('"')) & (F.size(F.split(LINE, ",")) <= len(columns))
    return rows.withColumn(LINE, F.when(F.lit(not multi_line) & ~short, F.col(LINE)))


def _load_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    parsers: dict[str, Column],
    required: Sequence[str],
    multi_line: bool,
) -> tuple[DataFrame, DataFrame]:
    """Typed rows, and the rejected rows as text with the reason."""
    names = schema.names
    raw = _read_text_csv(spark, path, names, multi_line)
    blank = {c: F.when(F.trim(c) != "", F.col(c)) for c in names}
    raw = raw.withColumns(blank)
    typed = {f.name: parsers.get(f.name, F.col(f.name).try_cast(f.dataType)) for f in schema.fields}
    bad = F.array_compact(
        F.array(
            F.when(F.col(LINE).isNotNull(), F.lit("broken line")),
            *[F.when(F.col(c).isNull(), F.lit(f"{c} missing")) for c in required],
            *[
                F.when(F.col(c).isNotNull() & typed[c].isNull(), F.lit(f"{c} unreadable"))
                for c in names
                if not isinstance(schema[c].dataType, (T.StringType, T.BooleanType))
            ],
        )
    )
    flagged = raw.withColumn("reject_reasons", bad)
    good = flagged.filter(F.size("reject_reasons") == 0).select(*[typed[c].alias(c) for c in names])
    return good, flagged.filter(F.size("reject_reasons") > 0)


def load_daily_csv(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Daily bars: empty fields are NULL; symbol and date are required. Large files are split by line."""
    return _load_csv(spark, path, schemas.DAILY, {}, ("symbol", "trade_date"), multi_line)


def load_bars_csv(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Intraday bars: the interval defaults to 1m, times carry micros and a zone. Files are split by line."""
    good, rejects = _load_csv(
        spark,
        path,
        schemas.BARS,
        {"ts": parse_ts_multi("ts"), "interval": F.coalesce("interval", F.lit("1m"))},
        ("symbol", "bucket_date", "ts"),
        multi_line,
    )
    return good, rejects


def load_news_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """News: five time formats, boolean words, and an id, code and date in every row."""
    return _load_csv(
        spark,
        path,
        schemas.NEWS,
        {"date": parse_ts_multi("date"), "crawled_at": parse_ts_multi("crawled_at"), "is_pdf": parse_bool("is_pdf")},
        ("article_id", "stock_code", "date"),
        multi_line=True,
    )


def read_alpha_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON objects {symbol: [formulas]} as (stock_code, pos, formula), and the unreadable files."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    parsed = files.withColumn("catalog", F.from_json("value", "map<string,array<string>>", {"mode": "PERMISSIVE"}))
    whole = F.try_parse_json("value").isNotNull()
    rows = (
        parsed.filter(whole)
        .select(F.explode("catalog").alias("stock_code", "formulas"))
        .select("stock_code", F.posexplode("formulas").alias("pos", "formula"))
    )
    return rows, files.filter(~whole).select("file")


def read_results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Result files of several batches, good and failed symbols in one table."""
    return spark.read.json(paths, schema=schemas.RESULT_ROWS, multiLine=True)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_model_runs(runs: DataFrame) -> DataFrame:
    """Model registry rows with a true date, the parts of the model name and the formula list."""
    parts = F.split("model_name", "_")
    return runs.withColumns(
        {
            "trained_on": F.try_to_timestamp("date_train", F.lit("dd/MM/yyyy")).cast("date"),
            "stock_code": F.try_element_at(parts, F.lit(2)),
            "model_type": F.try_element_at(parts, F.lit(5)),
            "formulas": decode_list("alphas"),
        }
    )
