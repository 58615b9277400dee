"""The same answers in DuckDB SQL, for the correctness check. One statement per query."""

from __future__ import annotations

from quotemill.sources.adapters import CHECKED_FORMULAS, FORMULAS

# --- domain tables as common table expressions --------------------------------------------------

RAW = """
raw_ticks AS (
  SELECT 'S' || (user_id % 20)::VARCHAR || '.VN' AS symbol, user_id % 20 AS n, value AS price,
         (epoch_us(ts) // 1000)::VARCHAR AS "timestamp", 'E' || ((user_id % 20) % 3)::VARCHAR AS exchange,
         1 AS quote_type, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS market_hours,
         CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS last_size,
         epoch_us(ts) // 1000 AS producer_timestamp, ts AS event_ts, event_id AS seq, event_type AS module
  FROM events)"""

TICKS = (
    RAW
    + """,
lagged AS (
  SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY event_ts, seq) AS prev_price,
         SUM(last_size) OVER (PARTITION BY symbol, CAST(event_ts AS DATE) ORDER BY event_ts, seq)::BIGINT AS day_volume
  FROM raw_ticks),
ticks AS (
  SELECT *, price - prev_price AS change,
         CASE WHEN prev_price <> 0 THEN (price - prev_price) / prev_price * 100.0 END AS change_percent
  FROM lagged),
valid AS (
  SELECT * FROM ticks
  WHERE price > 0 AND day_volume > 0 AND price < 1000000 AND abs(change_percent) < 50),
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY event_ts DESC, seq DESC) AS rn FROM ticks)
  WHERE rn = 1)"""
)

TICK_COLUMNS = "symbol, price, change, change_percent, day_volume, last_size, market_hours, event_ts, seq"

DAILY = (
    TICKS
    + """,
daily_raw AS (
  SELECT symbol, CAST(event_ts AS DATE) AS trade_date,
         floor(arg_min(price, row(event_ts, seq)) * 100.0 + 0.5) / 100.0 AS open,
         floor(max(price) * 100.0 + 0.5) / 100.0 AS high,
         floor(min(price) * 100.0 + 0.5) / 100.0 AS low,
         floor(arg_max(price, row(event_ts, seq)) * 100.0 + 0.5) / 100.0 AS close,
         arg_max(day_volume, row(event_ts, seq)) AS volume
  FROM valid WHERE market_hours = 1 GROUP BY ALL),
daily AS (
  SELECT symbol, trade_date, open, greatest(high, open, close) AS high, least(low, open, close) AS low, close, volume,
         floor((close - open) * 100.0 + 0.5) / 100.0 AS change,
         CASE WHEN open > 0 THEN floor((close - open) / open * 100 * 100.0 + 0.5) / 100.0 ELSE 0.0 END AS change_percent,
         'NASDAQ' AS exchange, 1 AS quote_type, 1 AS market_hours
  FROM daily_raw)"""
)

BOARD = (
    DAILY
    + """,
board AS (
  SELECT split_part(l.symbol, '.', 1) AS symbol,
         coalesce(f.close, 0.0) + floor(coalesce(f.close, 0.0) * 0.07 + 0.5) AS ceiling,
         coalesce(f.close, 0.0) - floor(coalesce(f.close, 0.0) * 0.07 + 0.5) AS floor,
         coalesce(f.close, 0.0) AS reference, coalesce(d.high, 0.0) AS high, coalesce(d.low, 0.0) AS low,
         coalesce(l.price, 0.0) AS price, coalesce(l.day_volume, 0) AS volume, coalesce(l.change, 0.0) AS change,
         coalesce(l.change_percent, 0.0) AS change_percent, coalesce(l.last_size, 0) AS last_size
  FROM latest l
  LEFT JOIN daily f ON f.symbol = l.symbol AND f.trade_date = DATE '2024-01-29'
  LEFT JOIN daily d ON d.symbol = l.symbol AND d.trade_date = DATE '2024-01-30')"""
)

BARS = """
trades AS (
  SELECT 'S' || (l_partkey % 10)::VARCHAR AS symbol, l_extendedprice / l_quantity AS price,
         CAST(l_quantity AS BIGINT) AS last_size, l_shipdate AS event_ts,
         row(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k
  FROM lineitem),
bars AS (
  SELECT symbol AS stock_code, CAST(event_ts AS DATE) AS trade_date, count(*) AS ticks,
         arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close,
         SUM(last_size)::BIGINT AS volume, sum(price * last_size) / SUM(last_size)::DOUBLE AS vwap
  FROM trades GROUP BY ALL)"""

PREDICTIONS = (
    BARS
    + """,
weekday_bars AS (
  SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY trade_date) AS n
  FROM bars WHERE isodow(trade_date) < 6),
predictions AS (
  SELECT stock_code, trade_date + CASE WHEN isodow(trade_date) = 5 THEN 3 ELSE 1 END AS prediction_date,
         close * (1.0::DOUBLE + (n % 7 - 3)::DOUBLE / 100.0::DOUBLE) AS predicted_price,
         1.0::DOUBLE / (1.0::DOUBLE + (n % 5)::DOUBLE) AS confidence_score
  FROM weekday_bars),
newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY prediction_date DESC) AS rn FROM predictions)
  WHERE rn = 1),
actuals AS (
  SELECT p.*, p.prediction_date - CASE isodow(p.prediction_date) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS prev_date
  FROM predictions p)"""
)

NEWS = """
news AS (
  SELECT d.doc_id, d.doc_id::VARCHAR AS article_id, 'S' || (d.doc_id % 10)::VARCHAR AS stock_code,
         split_part(text, chr(10), 1) AS title,
         CAST(DATE '1995-01-02' + CAST(d.doc_id % 365 AS INTEGER) AS TIMESTAMP) AS date,
         CAST(DATE '1995-01-02' + CAST(d.doc_id % 365 AS INTEGER) AS DATE) AS news_date,
         d.doc_id % 4 = 0 AS is_pdf, text AS content, CAST(quality - toxic AS DOUBLE) AS sentiment_score,
         CASE WHEN d.doc_id % 4 = 0 THEN 'https://files.example/' || d.doc_id::VARCHAR END AS pdf_link
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

CODES = """
codes AS (
  SELECT 'S' || n::VARCHAR AS stock_code, n
  FROM (SELECT user_id % 20 AS n FROM events UNION SELECT l_partkey % 10 AS n FROM lineitem)),
sectors AS (
  SELECT stock_code, r_name AS sector FROM codes JOIN region ON r_regionkey = n % 5)"""

MENTIONS = """
doc_words AS (
  SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS word FROM documents),
mention_codes AS (
  SELECT word AS stock_code, row_number() OVER (ORDER BY df DESC, word) - 1 AS n
  FROM (SELECT word, count(*) AS df FROM doc_words WHERE regexp_full_match(word, '\\p{L}{2,}') GROUP BY word
        ORDER BY df DESC, word LIMIT 30)),
own AS (SELECT d.doc_id, c.stock_code FROM documents d JOIN mention_codes c ON c.n = d.doc_id % 30)"""

SAMPLES = (
    TICKS
    + """,
samples AS (SELECT symbol, event_ts AS ts, seq, CAST(day_volume AS DOUBLE) AS value FROM ticks),
stepped AS (SELECT *, lag(value) OVER (PARTITION BY symbol ORDER BY ts, seq) AS before FROM samples)"""
)

CHANGES = """
change_samples AS (
  SELECT 'S' || (user_id % 20)::VARCHAR AS symbol, ts, event_id AS seq, value * 10.0 AS latency_ms, event_type AS module
  FROM events)"""

HISTOGRAM = (
    CHANGES
    + """,
bounds AS (SELECT unnest([10, 50, 100, 200, 500, 1000, 2000, 5000]) AS b),
bucket_rows AS (
  SELECT symbol, b::DOUBLE AS bound, b::VARCHAR AS le, count(*) FILTER (WHERE latency_ms <= b) AS bucket_count,
         count(*) AS events, round(sum(latency_ms), 4) AS latency_sum
  FROM change_samples, bounds GROUP BY ALL
  UNION ALL
  SELECT symbol, 'inf'::DOUBLE, '+Inf', count(*), count(*), round(sum(latency_ms), 4) FROM change_samples GROUP BY ALL)"""
)


def grid(ts: str, step: int) -> str:
    """First grid time at or after a time."""
    return f"CAST(make_timestamp(CAST(ceil(epoch_us({ts}) / {step * 1000000}.0) * {step * 1000000} AS BIGINT)) AS TIMESTAMP)"


def stepped_sums(window: int, step: int) -> str:
    """Sums of each series over the window before every grid time."""
    shifts = ", ".join(str(i) for i in range(window // step))
    return (
        SAMPLES
        + f""",
sums AS (
  SELECT symbol, at_time + k * INTERVAL {step} SECOND AS at_time,
         sum(CASE WHEN value < before THEN value WHEN value >= before THEN value - before END) AS increase,
         count(*) FILTER (WHERE value <> before) AS changes, count(*) FILTER (WHERE value < before) AS resets
  FROM (SELECT *, {grid("ts", step)} AS at_time FROM stepped), (SELECT unnest([{shifts}]) AS k) GROUP BY ALL)"""
    )


# recursive smoothing over numbered bars; gains and losses start with 0 as the first bar has no step
RECURSIVE = (
    BARS.replace("\ntrades AS", "RECURSIVE trades AS", 1)
    + """,
numbered AS (
  SELECT stock_code, trade_date, close, row_number() OVER w AS n, close - lag(close) OVER w AS step
  FROM bars WINDOW w AS (PARTITION BY stock_code ORDER BY trade_date)),
smooth AS (
  SELECT stock_code, trade_date, n, close AS e10, close AS e12, close AS e26,
         0.0::DOUBLE AS gain, 0.0::DOUBLE AS loss, NULL::DOUBLE AS sig
  FROM numbered WHERE n = 1
  UNION ALL
  SELECT b.stock_code, b.trade_date, b.n,
         s.e10 * (1 - 2.0::DOUBLE / 11) + b.close * (2.0::DOUBLE / 11),
         s.e12 * (1 - 2.0::DOUBLE / 13) + b.close * (2.0::DOUBLE / 13),
         s.e26 * (1 - 2.0::DOUBLE / 27) + b.close * (2.0::DOUBLE / 27),
         s.gain * (1 - 1.0::DOUBLE / 14) + greatest(b.step, 0) * (1.0::DOUBLE / 14),
         s.loss * (1 - 1.0::DOUBLE / 14) + greatest(-b.step, 0) * (1.0::DOUBLE / 14),
         CASE WHEN b.n < 26 THEN NULL
              WHEN b.n = 26 THEN (s.e12 * (1 - 2.0::DOUBLE / 13) + b.close * (2.0::DOUBLE / 13)) - (s.e26 * (1 - 2.0::DOUBLE / 27) + b.close * (2.0::DOUBLE / 27))
              ELSE s.sig * 0.8::DOUBLE + ((s.e12 * (1 - 2.0::DOUBLE / 13) + b.close * (2.0::DOUBLE / 13)) - (s.e26 * (1 - 2.0::DOUBLE / 27) + b.close * (2.0::DOUBLE / 27))) * 0.2::DOUBLE END
  FROM smooth s JOIN numbered b ON b.stock_code = s.stock_code AND b.n = s.n + 1),
recursive_values AS (
  SELECT stock_code, trade_date,
         CASE WHEN n >= 10 THEN e10 END AS "EMA_10",
         CASE WHEN n >= 14 THEN CASE WHEN loss = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + gain / loss) END END AS "RSI_14",
         CASE WHEN n >= 26 THEN e12 - e26 END AS "MACD",
         CASE WHEN n >= 34 THEN sig END AS "MACD_Signal"
  FROM smooth)"""
)

FEATURES = (
    RECURSIVE
    + ","
    + NEWS
    + """,
framed AS (
  SELECT *,
         CASE WHEN count(*) OVER w20 >= 20 THEN avg(close) OVER w20 END AS "SMA_20",
         CASE WHEN count(*) OVER w20 >= 20 THEN avg(close) OVER w20 + 2 * stddev_pop(close) OVER w20 END AS "BB_Upper",
         CASE WHEN count(*) OVER w20 >= 20 THEN avg(close) OVER w20 - 2 * stddev_pop(close) OVER w20 END AS "BB_Lower",
         (close - lag(close, 3) OVER w) / lag(close, 3) OVER w * 100.0 AS "Momentum_3",
         (close - lag(close, 10) OVER w) / lag(close, 10) OVER w * 100.0 AS "Momentum_10",
         close < lag(close) OVER w AS fell
  FROM bars
  WINDOW w AS (PARTITION BY stock_code ORDER BY trade_date),
         w20 AS (PARTITION BY stock_code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
signed AS (
  SELECT *, CAST(SUM(CASE WHEN fell THEN -volume ELSE volume END)
                 OVER (PARTITION BY stock_code ORDER BY trade_date) AS DOUBLE) AS "OBV" FROM framed),
polarities AS (SELECT stock_code, news_date AS trade_date, avg(sentiment_score) AS polarity FROM news GROUP BY ALL),
features AS (
  SELECT f.*, v."EMA_10", v."RSI_14", v."MACD", v."MACD_Signal", coalesce(p.polarity, 0.0) AS polarity
  FROM signed f JOIN recursive_values v USING (stock_code, trade_date)
  LEFT JOIN polarities p USING (stock_code, trade_date)
  WHERE v."MACD_Signal" IS NOT NULL)"""
)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# the expressions of FORMULAS as SQL, with undefined values as NULL
FORMULA_SQL = (
    '(close - "SMA_20") / nullif("SMA_20", 0)',
    '("RSI_14" - 50) / 50',
    '"Momentum_3" - "Momentum_10"',
    '("BB_Upper" - close) / nullif("BB_Upper" - "BB_Lower", 0)',
    '"MACD" - "MACD_Signal"',
    "(high - low) / nullif(open, 0) * volume",
)
ALPHAS = (
    FEATURES
    + ", alphas AS ("
    + " UNION ALL ".join(
        f"SELECT stock_code, trade_date, {_text(f)} AS formula, {e} AS value FROM features"
        for f, e in zip(FORMULAS, FORMULA_SQL, strict=True)
    )
    + """),
returns AS (
  SELECT stock_code, trade_date, (lead(close) OVER w - close) / nullif(close, 0) * 100.0 AS future_return
  FROM features WINDOW w AS (PARTITION BY stock_code ORDER BY trade_date)),
pairs AS (
  SELECT a.stock_code, formula,
         rank() OVER (PARTITION BY a.stock_code, formula ORDER BY value)
           + (count(*) OVER (PARTITION BY a.stock_code, formula, value) - 1) / 2.0 AS ra,
         rank() OVER (PARTITION BY a.stock_code, formula ORDER BY future_return)
           + (count(*) OVER (PARTITION BY a.stock_code, formula, future_return) - 1) / 2.0 AS rb
  FROM alphas a JOIN returns r USING (stock_code, trade_date)
  WHERE value IS NOT NULL AND future_return IS NOT NULL),
scores AS (
  SELECT stock_code, formula, CASE WHEN count(*) >= 10 THEN corr(ra, rb) END AS rank_ic,
         CASE WHEN count(*) >= 10 THEN count(*) ELSE 0 END AS n_samples
  FROM pairs GROUP BY ALL)"""
)

_PROBLEMS = {
    "close.shift(1)": ("close.shift(1)", "forbidden call .shift("),
    "close / missing": ("close / missing", "unknown name missing"),
    "((close)": ("((close)", "unbalanced brackets"),
    "close >= open": ("close >= open", None),
    "a = ": ("", "empty"),
    "close ×2": ("close *2", None),
    "Alpha2 = (RSI_14 - 50) / 50": ("(RSI_14 - 50) / 50", None),
}
CHECKED = ", ".join(
    "({}, {}, {})".format(
        _text(f), _text(_PROBLEMS.get(f, (f, None))[0]), _text(_PROBLEMS[f][1]) if _PROBLEMS.get(f, (f, None))[1] else "NULL"
    )
    for f in CHECKED_FORMULAS
)
CATALOG = ", ".join(f"({_text(f)}, {i})" for i, f in enumerate(FORMULAS))

LINEAR = (
    BARS
    + """,
shares AS (SELECT stock_code, trade_date, close, cume_dist() OVER (PARTITION BY stock_code ORDER BY trade_date) AS share FROM bars),
cuts AS (SELECT stock_code, max(trade_date) AS cut FROM shares WHERE share <= 0.8 GROUP BY ALL),
scaling AS (SELECT stock_code, min(close) AS low, CASE WHEN max(close) = min(close) THEN 1.0 ELSE max(close) - min(close) END AS span
            FROM shares WHERE share <= 0.8 GROUP BY ALL),
steps AS (
  SELECT stock_code, (close - scaling.low) / span AS x, lead((close - scaling.low) / span) OVER w AS y, lead(trade_date) OVER w AS target_date
  FROM bars JOIN scaling USING (stock_code) WINDOW w AS (PARTITION BY stock_code ORDER BY trade_date)),
windows AS (SELECT *, count(*) OVER (PARTITION BY stock_code) AS n_windows FROM steps WHERE target_date IS NOT NULL),
fits AS (
  SELECT stock_code, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept
  FROM windows JOIN cuts USING (stock_code) WHERE target_date <= cut AND n_windows >= 50 GROUP BY ALL)"""
)

MODEL_RUNS = (
    BARS
    + """,
months AS (
  SELECT stock_code, CAST(date_trunc('month', trade_date) AS DATE) AS trained_on, 1.0::DOUBLE / max(high) AS mse_loss,
         CASE WHEN max(volume) % 2 = 0 THEN 'Linear' ELSE 'Trees' END AS model_type
  FROM bars GROUP BY ALL),
runs AS (
  SELECT *, 'StockModel_' || stock_code || '_' || strftime(trained_on, '%Y%m%d') || '_000000_' || model_type AS model_name
  FROM months)"""
)


def _bars_over(interval: str, source: str = "ticks") -> str:
    return f"""
SELECT symbol, CAST(time_bucket(INTERVAL '{interval}', event_ts, TIMESTAMP '2000-01-01') AS DATE) AS bucket_date,
       LABEL AS interval, time_bucket(INTERVAL '{interval}', event_ts, TIMESTAMP '2000-01-01') AS ts,
       arg_min(price, row(event_ts, seq)) AS open, max(price) AS high, min(price) AS low,
       arg_max(price, row(event_ts, seq)) AS close, SUM(last_size)::BIGINT AS volume,
       round(CASE WHEN SUM(last_size) = 0 THEN arg_max(price, row(event_ts, seq))
             ELSE sum(price * last_size) / SUM(last_size)::DOUBLE END + 1e-9, 4) AS vwap
FROM {source} WHERE market_hours = 1 GROUP BY ALL"""


def _rollup(interval: str, label: str) -> str:
    fine = _bars_over("1 minute").replace("LABEL", "'1m'").replace("round(CASE", "(CASE").replace(" + 1e-9, 4)", ")")
    return f"""WITH {TICKS}, fine AS ({fine})
SELECT symbol, CAST(time_bucket(INTERVAL '{interval}', ts, TIMESTAMP '2000-01-01') AS DATE) AS bucket_date, '{label}' AS interval,
       time_bucket(INTERVAL '{interval}', ts, TIMESTAMP '2000-01-01') AS ts, arg_min(open, ts) AS open, max(high) AS high,
       min(low) AS low, arg_max(close, ts) AS close, SUM(volume)::BIGINT AS volume,
       round(CASE WHEN SUM(volume) = 0 THEN arg_max(vwap, ts) ELSE sum(vwap * volume) / SUM(volume)::DOUBLE END + 1e-9, 4) AS vwap
FROM fine f GROUP BY symbol, time_bucket(INTERVAL '{interval}', ts, TIMESTAMP '2000-01-01')"""


_NEWS_COLUMNS = "article_id, stock_code, date, is_pdf"

# the local time of the market has no daylight saving: seven hours ahead of UTC
CALENDAR = (
    RAW
    + """,
local_times AS (
  SELECT seq, event_ts + INTERVAL 7 HOUR AS lt, CAST(event_ts + INTERVAL 7 HOUR AS DATE) AS d,
         isodow(event_ts + INTERVAL 7 HOUR) - 1 AS wd, hour(event_ts + INTERVAL 7 HOUR) AS h,
         CAST(event_ts AS DATE) AS ud, isodow(event_ts) - 1 AS uwd
  FROM raw_ticks)"""
)

def _running(width: str, delay: str, volume: str) -> str:
    """Each tick's bar so far: a quarter of the ticks comes in a second batch, less those whose bar has closed."""
    cents = lambda x: f"floor({x} * 100.0 + 0.5) / 100.0"
    return f"""WITH {TICKS}, m AS (SELECT max(event_ts) AS seen FROM valid WHERE seq % 4 <> 0),
n AS (SELECT *, (seq % 4 = 0)::INT AS batch, time_bucket(INTERVAL {width}, event_ts, TIMESTAMP '2000-01-01') AS ts,
             row_number() OVER (PARTITION BY symbol ORDER BY event_ts, seq) AS place FROM valid WHERE market_hours = 1),
kept AS (SELECT n.* FROM n, m WHERE batch = 0 OR ts + INTERVAL {width} > seen - INTERVAL {delay})
SELECT symbol, CAST(ts AS DATE) AS bucket_date, ts, event_ts, seq, count(*) OVER w AS ticks, {cents("arg_min(price, place) OVER w")} AS open,
       {cents("arg_max(price, place) OVER w")} AS "close", {cents("max(price) OVER w")} AS high, {cents("min(price) OVER w")} AS low, {volume} AS volume
FROM kept WINDOW w AS (PARTITION BY symbol, ts ORDER BY batch, place ROWS UNBOUNDED PRECEDING)"""


ORACLE: dict[str, str] = {
    # sources and sinks
    "ticks": f'WITH {TICKS} SELECT {TICK_COLUMNS}, "timestamp", exchange, producer_timestamp FROM ticks',
    "normalized_quotes": f"""WITH {RAW}
SELECT symbol, CASE WHEN last_size > 10 THEN price ELSE 0.0 END AS price, "timestamp",
       CASE WHEN market_hours = 1 THEN exchange ELSE '' END AS exchange, 0 AS quote_type, 0 AS market_hours,
       0.0::DOUBLE AS change_percent, 0::BIGINT AS day_volume, 0.0::DOUBLE AS change, last_size, '' AS price_hint, seq
FROM raw_ticks""",
    "daily_csv_round_trip": f"""WITH {BARS}
SELECT stock_code AS symbol, trade_date, open, high, low, close, volume, NULL::DOUBLE AS change FROM bars""",
    "bars_csv_round_trip": f"""WITH {TICKS}, b AS ({_bars_over("1 minute").replace("LABEL", "'1m'")})
SELECT symbol, bucket_date, interval, ts, floor(open * 100.0 + 0.5) / 100.0 AS open, floor(high * 100.0 + 0.5) / 100.0 AS high,
       floor(low * 100.0 + 0.5) / 100.0 AS low, floor(close * 100.0 + 0.5) / 100.0 AS close, volume FROM b""",
    "news_csv_round_trip": f"""WITH {NEWS}
SELECT article_id, stock_code, date, is_pdf, length(content)::BIGINT AS content_chars FROM news""",
    "upsert_daily": f"""WITH {BARS},
m AS (SELECT stock_code, CAST(date_trunc('month', trade_date) AS DATE) AS month, max(high) AS high, SUM(volume)::BIGINT AS volume
      FROM bars GROUP BY ALL)
SELECT stock_code, month, high, volume + CASE WHEN month >= DATE '1998-06-01' THEN 1 ELSE 0 END AS volume FROM m""",
    "upsert_keep_stored": f"""WITH {BARS}, {CODES}, base AS (SELECT stock_code, SUM(volume)::BIGINT AS volume FROM bars GROUP BY ALL)
SELECT stock_code, coalesce(volume, -1) AS volume FROM codes LEFT JOIN base USING (stock_code)""",
    "replace_formulas": f"""WITH {BARS}, c AS (
  SELECT stock_code, f AS alpha_formula, i / 10.0::DOUBLE AS rank_ic
  FROM (SELECT DISTINCT stock_code FROM bars), (VALUES {CATALOG}) AS v(f, i))
SELECT *, '01/01/2024' AS date_calculated FROM c WHERE stock_code >= 'S5'
UNION ALL SELECT *, '02/01/2024' FROM c WHERE stock_code < 'S5' AND rank_ic < 0.2""",
    "delete_formulas": f"""WITH {BARS}
SELECT stock_code, f AS alpha_formula, i / 10.0::DOUBLE AS rank_ic
FROM (SELECT DISTINCT stock_code FROM bars), (VALUES {CATALOG}) AS v(f, i) WHERE stock_code < 'S6'""",
    "article_links": """
SELECT page_id, unnest(range(len(l)))::BIGINT AS pos, unnest(l) AS link
FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS l FROM pages)""",
    "page_titles": """
SELECT page_id, trim(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS title,
       len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"'))::BIGINT AS n_links, FALSE AS is_pdf FROM pages""",
    # filters
    "valid_ticks": f"WITH {TICKS} SELECT {TICK_COLUMNS} FROM valid",
    "session_flag_ticks": f"WITH {TICKS} SELECT {TICK_COLUMNS} FROM ticks WHERE market_hours = 1",
    "basket_latest": f"WITH {TICKS} SELECT symbol, price, seq FROM latest WHERE n < 5",
    "session_ticks": f"""WITH {TICKS} SELECT {TICK_COLUMNS} FROM ticks
WHERE symbol = 'S3.VN' AND producer_timestamp BETWEEN epoch_ms(TIMESTAMP '2024-01-16 02:00:00') AND epoch_ms(TIMESTAMP '2024-01-16 08:00:00')""",
    "week_ticks": f"""WITH {TICKS} SELECT {TICK_COLUMNS} FROM ticks
WHERE symbol = 'S3.VN' AND producer_timestamp BETWEEN epoch_ms(TIMESTAMP '2024-01-14 00:00:00') AND epoch_ms(TIMESTAMP '2024-01-20 23:59:59')""",
    "daily_range": f"""WITH {DAILY} SELECT symbol, trade_date, open, high, low, close, volume FROM daily
WHERE symbol = 'S3.VN' AND trade_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-19'""",
    "bars_on_date": f"""WITH {DAILY} SELECT split_part(symbol, '.', 1) AS symbol, trade_date, open, high, low, close, volume
FROM daily WHERE trade_date = DATE '2024-01-30'""",
    "news_filtered": f"""WITH {NEWS}, {CODES}, asia AS (SELECT * FROM news WHERE stock_code IN (SELECT stock_code FROM sectors WHERE sector = 'ASIA'))
SELECT 'dates' AS filter_name, {_NEWS_COLUMNS} FROM news WHERE date >= TIMESTAMP '1995-03-01' AND date < TIMESTAMP '1995-04-01'
UNION ALL SELECT 'today', {_NEWS_COLUMNS} FROM news WHERE date >= TIMESTAMP '1995-12-20' AND date < TIMESTAMP '1995-12-21'
UNION ALL SELECT 'week', {_NEWS_COLUMNS} FROM news WHERE date >= TIMESTAMP '1995-12-13 12:00:00'
UNION ALL SELECT 'month', {_NEWS_COLUMNS} FROM asia WHERE date >= TIMESTAMP '1995-12-01' AND date < TIMESTAMP '1996-01-01'
UNION ALL SELECT 'year', {_NEWS_COLUMNS} FROM asia WHERE date >= TIMESTAMP '1994-12-20 12:00:00' AND (title LIKE '%the%' OR content LIKE '%the%')""",
    "news_text_search": f"WITH {NEWS} SELECT {_NEWS_COLUMNS} FROM news WHERE title LIKE '%the%and%' OR content LIKE '%the%and%'",
    "news_recent": f"""WITH {NEWS}
SELECT 'today' AS filter_name, {_NEWS_COLUMNS} FROM news WHERE date >= TIMESTAMP '1995-12-20'
UNION ALL SELECT 'week', {_NEWS_COLUMNS} FROM news WHERE date >= TIMESTAMP '1995-12-13 12:00:00'
UNION ALL SELECT 'month', {_NEWS_COLUMNS} FROM news WHERE date >= TIMESTAMP '1995-11-20 12:00:00'
UNION ALL SELECT 'custom', {_NEWS_COLUMNS} FROM news WHERE date >= TIMESTAMP '1995-02-01' AND date < TIMESTAMP '1995-02-11'""",
    "high_sentiment": f"""WITH {NEWS} SELECT stock_code, news_date, sentiment_score, article_id FROM news
WHERE sentiment_score > 0.5 ORDER BY news_date DESC, stock_code, article_id LIMIT 10""",
    "future_predictions": f"""WITH {PREDICTIONS} SELECT stock_code, prediction_date, predicted_price FROM predictions
WHERE prediction_date > DATE '2000-01-01'""",
    # joins
    "prices_with_sentiment": f"""WITH {BARS}, {NEWS}
SELECT b.stock_code, b.trade_date, b.close, b.volume, round(avg(n.sentiment_score), 4) + 0.0 AS polarity
FROM bars b LEFT JOIN news n ON n.stock_code = b.stock_code AND n.news_date = b.trade_date GROUP BY ALL""",
    "training_view": f"""WITH {BARS}, {NEWS}, {CODES}
SELECT b.stock_code, b.trade_date, b.open, b.close, b.volume, 'E' || (c.n % 3)::VARCHAR AS exchange, n.sentiment_score, n.article_id
FROM bars b JOIN codes c USING (stock_code)
LEFT JOIN news n ON n.stock_code = b.stock_code AND n.news_date = b.trade_date WHERE b.trade_date >= DATE '1995-01-01'""",
    "related_sentiment": f"""WITH {BARS}, {NEWS}, {CODES}, pol AS (SELECT stock_code, news_date, avg(sentiment_score) AS p FROM news GROUP BY ALL)
SELECT b.stock_code, b.trade_date, y.stock_code AS partner, round(p.p, 4) + 0.0 AS partner_polarity
FROM bars b JOIN sectors x ON x.stock_code = b.stock_code JOIN sectors y ON y.sector = x.sector AND y.stock_code <> x.stock_code
LEFT JOIN pol p ON p.stock_code = y.stock_code AND p.news_date = b.trade_date""",
    "partner_sentiment": f"""WITH {MENTIONS}, {NEWS},
pairs AS (
  SELECT o.stock_code, c.stock_code AS partner, count(*) AS n_articles
  FROM own o JOIN doc_words self ON self.doc_id = o.doc_id AND self.word = o.stock_code
  JOIN doc_words w ON w.doc_id = o.doc_id JOIN mention_codes c ON c.stock_code = w.word
  WHERE c.stock_code <> o.stock_code GROUP BY ALL),
partners AS (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY n_articles DESC, partner) AS position FROM pairs),
m AS (SELECT o.stock_code, n.news_date, n.sentiment_score FROM own o JOIN news n USING (doc_id)),
pol AS (SELECT stock_code, news_date, avg(sentiment_score) AS p FROM m GROUP BY ALL)
SELECT d.stock_code, d.news_date AS trade_date, r.partner, round(pol.p, 4) + 0.0 AS partner_polarity
FROM (SELECT DISTINCT stock_code, news_date FROM m) d JOIN partners r ON r.stock_code = d.stock_code AND r.position <= 5
LEFT JOIN pol ON pol.stock_code = r.partner AND pol.news_date = d.news_date""",
    "prediction_actuals": f"""WITH {PREDICTIONS}
SELECT a.stock_code, a.prediction_date, a.predicted_price, a.prev_date, q.close AS prev_close, c.close AS actual_close
FROM actuals a JOIN bars c ON c.stock_code = a.stock_code AND c.trade_date = a.prediction_date
JOIN bars q ON q.stock_code = a.stock_code AND q.trade_date = a.prev_date""",
    "prediction_trends": f"""WITH {DAILY}, {PREDICTIONS}
SELECT p.stock_code, CASE WHEN predicted_price > coalesce(d.close, 0) THEN 'up' WHEN predicted_price < coalesce(d.close, 0) THEN 'down' ELSE 'neutral' END AS prediction_trend, confidence_score
FROM newest p LEFT JOIN daily d ON d.symbol = p.stock_code || '.VN' AND d.trade_date = DATE '2024-01-29'""",
    "market_board": f"WITH {BOARD} SELECT * FROM board",
    "new_articles": f"WITH {NEWS} SELECT article_id, stock_code FROM news WHERE sentiment_score IS NULL",
    "unprocessed_pdfs": f"""WITH {NEWS} SELECT article_id, stock_code, pdf_link FROM news
WHERE is_pdf AND NOT coalesce(sentiment_score > 0, FALSE)""",
    "news_with_sector": f"WITH {NEWS}, {CODES} SELECT article_id, stock_code, sector FROM news JOIN sectors USING (stock_code)",
    "mention_pairs": f"""WITH {MENTIONS}
SELECT w.doc_id::VARCHAR AS article_id, o.stock_code, c.stock_code AS mentioned
FROM doc_words w JOIN mention_codes c ON c.stock_code = w.word JOIN own o USING (doc_id)""",
    "attached_formulas": f"""WITH {BARS}
SELECT stock_code, f AS formula, count(*) AS n_rows, max(trade_date) AS last_date
FROM bars, (VALUES {CATALOG}) AS v(f, i) GROUP BY ALL""",
    # aggregations
    "latest_by_symbol": f"WITH {TICKS} SELECT {TICK_COLUMNS} FROM latest",
    "daily_bars": f"""WITH {TICKS}
SELECT symbol, CAST(event_ts AS DATE) AS trade_date, count(*) AS ticks, arg_min(price, row(event_ts, seq)) AS open,
       max(price) AS high, min(price) AS low, arg_max(price, row(event_ts, seq)) AS close,
       arg_max(day_volume, row(event_ts, seq)) AS volume,
       round(CASE WHEN count(*) > 1 THEN sum(price * last_size) / arg_max(day_volume, row(event_ts, seq))::DOUBLE
             ELSE arg_max(price, row(event_ts, seq)) END + 1e-9, 4) + 0.0 AS vwap
FROM valid WHERE market_hours = 1 GROUP BY ALL""",
    "daily_bars_traded": f"WITH {BARS} SELECT stock_code, trade_date, ticks, open, high, low, close, volume, round(vwap + 1e-9, 4) AS vwap FROM bars",
    "finalized_daily": f"WITH {DAILY} SELECT * FROM daily",
    "minute_bars": f"WITH {TICKS} {_bars_over('1 minute').replace('LABEL', chr(39) + '1m' + chr(39))}",
    "hourly_bars": f"WITH {TICKS} {_bars_over('1 hour').replace('LABEL', chr(39) + '1h' + chr(39))}",
    "five_minute_rollup": _rollup("5 minutes", "5m"),
    "daily_rollup": _rollup("1 day", "1d"),
    "daily_sentiment": f"WITH {NEWS} SELECT stock_code, news_date AS trade_date, round(avg(sentiment_score), 4) + 0.0 AS polarity FROM news GROUP BY ALL",
    "related_companies": f"""WITH {MENTIONS},
pairs AS (
  SELECT o.stock_code, c.stock_code AS partner, count(*) AS n_articles
  FROM own o JOIN doc_words self ON self.doc_id = o.doc_id AND self.word = o.stock_code
  JOIN doc_words w ON w.doc_id = o.doc_id JOIN mention_codes c ON c.stock_code = w.word
  WHERE c.stock_code <> o.stock_code GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY n_articles DESC, partner) AS position FROM pairs)
WHERE position <= 5""",
    "distinct_symbols": f"WITH {RAW} SELECT DISTINCT symbol FROM raw_ticks",
    "high_water_marks": f"WITH {BARS} SELECT 'bars' AS table_name, max(trade_date) AS high_water_mark FROM bars UNION ALL SELECT 'none', NULL",
    "dedupe_first": f"""WITH {RAW} SELECT symbol, exchange, quote_type, seq, price FROM
(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS rn FROM raw_ticks) WHERE rn = 1""",
    "sector_counts": f"""WITH {NEWS}, {CODES}
SELECT 'all' AS sector, 'All' AS label, count(DISTINCT stock_code) AS n_codes FROM news
UNION ALL SELECT sector, upper(sector[1]) || lower(sector[2:]), count(DISTINCT stock_code) FROM news JOIN sectors USING (stock_code) GROUP BY sector""".replace(
        "upper(sector[1]) || lower(sector[2:])",
        "array_to_string(list_transform(string_split(replace(sector, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')",
    ),
    "news_by_sector": f"""WITH {NEWS}, {CODES},
c AS (SELECT stock_code, sector, count(*) AS n_articles FROM news JOIN sectors USING (stock_code) GROUP BY ALL)
SELECT sector, sector_total, round(sector_total * 100.0::DOUBLE / n_news, 4) + 0.0 AS share_percent, n_news, stock_code, n_articles, position
FROM (SELECT *, SUM(n_articles) OVER (PARTITION BY sector)::BIGINT AS sector_total, (SELECT count(*) FROM news) AS n_news,
             row_number() OVER (PARTITION BY sector ORDER BY n_articles DESC, stock_code) AS position FROM c) WHERE position <= 5""",
    "market_breadth": f"""WITH {BOARD}
SELECT count(*) FILTER (WHERE change > 0) AS advancing, count(*) FILTER (WHERE change < 0) AS declining,
       count(*) FILTER (WHERE change = 0) AS unchanged, SUM(volume)::BIGINT AS total_volume,
       round(avg(change_percent), 4) + 0.0 AS avg_change_percent FROM board""",
    "sector_volume": f"""WITH {BOARD}, {CODES},
s AS (SELECT sector, SUM(volume)::BIGINT AS volume, count(*) AS n_symbols FROM board JOIN sectors ON stock_code = symbol GROUP BY ALL HAVING SUM(volume) > 0)
SELECT *, round(volume * 100.0::DOUBLE / SUM(volume) OVER ()::DOUBLE, 4) + 0.0 AS share_percent FROM s""",
    "prediction_accuracy": f"""WITH {PREDICTIONS},
x AS (
  SELECT a.stock_code, sign(a.predicted_price - q.close) = sign(c.close - q.close) AS hit
  FROM actuals a JOIN bars c ON c.stock_code = a.stock_code AND c.trade_date = a.prediction_date
  JOIN bars q ON q.stock_code = a.stock_code AND q.trade_date = a.prev_date)
SELECT stock_code, count(*) FILTER (WHERE hit) AS correct, count(*) AS total,
       round_even(count(*) FILTER (WHERE hit) / count(*)::DOUBLE * 100, 2) AS accuracy FROM x GROUP BY ALL""",
    "period_summary": f"""WITH {BARS}
SELECT stock_code, max(high) AS highest, min(low) AS lowest, round(avg(volume), 4) + 0.0 AS avg_volume
FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY trade_date DESC) AS rn FROM bars) WHERE rn <= 180 GROUP BY ALL""",
    "session_summary": f"""WITH {TICKS}
SELECT symbol, arg_min(price, row(event_ts, seq)) AS open, max(price) AS high, min(price) AS low,
       arg_max(price, row(event_ts, seq)) AS close FROM valid GROUP BY ALL""",
    "table_counts": f"""WITH {PREDICTIONS}, {NEWS}, {CODES}
SELECT 'bars' AS table_name, count(*) AS n_rows FROM bars UNION ALL SELECT 'news', count(*) FROM news
UNION ALL SELECT 'dim_stock', count(*) FROM codes UNION ALL SELECT 'predictions', count(*) FROM predictions""",
    "alpha_catalog": f"""WITH {BARS} SELECT stock_code, i::BIGINT AS pos, f AS formula FROM (SELECT DISTINCT stock_code FROM bars), (VALUES {CATALOG}) AS v(f, i)""",
    "result_rows": f"""WITH {BARS} SELECT stock_code, close AS predicted_price, CASE WHEN close > 2000 THEN 'price ' || stock_code END AS error FROM bars""",
    "cleaned_columns": f"WITH {BARS} SELECT stock_code, trade_date, close AS close_price_VND FROM bars",
    "run_summary": f"""WITH {BARS}
SELECT count(*) AS total, count(*) FILTER (WHERE NOT close > 2000) AS success, count(*) FILTER (WHERE close > 2000) AS failed
FROM bars""",
    "formula_audit": f"""WITH {BARS}, s AS (SELECT DISTINCT stock_code FROM bars)
SELECT stock_code, 'wrong number of formulas' AS issue, '{len(CHECKED_FORMULAS)}' AS detail FROM s
UNION ALL SELECT stock_code, 'forbidden call', 'close.shift(1)' FROM s""",
    # windows and time series
    "moving_averages": f"""WITH {BARS}
SELECT stock_code, trade_date,
       round(CASE WHEN count(*) OVER w5 >= 5 THEN avg(close) OVER w5 END + 1e-9, 4) + 0.0 AS sma_5,
       round(CASE WHEN count(*) OVER w20 >= 20 THEN avg(close) OVER w20 END + 1e-9, 4) + 0.0 AS sma_20
FROM bars WINDOW w5 AS (PARTITION BY stock_code ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
                 w20 AS (PARTITION BY stock_code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "rate_of_change": f"""WITH {BARS}
SELECT stock_code, trade_date, (close - lag(close, 3) OVER w) / lag(close, 3) OVER w * 100.0 AS roc_3,
       (close - lag(close, 10) OVER w) / lag(close, 10) OVER w * 100.0 AS roc_10
FROM bars WINDOW w AS (PARTITION BY stock_code ORDER BY trade_date)""",
    "bollinger_bands": f"""WITH {BARS}
SELECT stock_code, trade_date,
       round(CASE WHEN count(*) OVER w >= 20 THEN avg(close) OVER w + 2 * stddev_pop(close) OVER w END, 3) + 0.0 AS bb_upper,
       round(CASE WHEN count(*) OVER w >= 20 THEN avg(close) OVER w - 2 * stddev_pop(close) OVER w END, 3) + 0.0 AS bb_lower
FROM bars WINDOW w AS (PARTITION BY stock_code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "on_balance_volume": f"""WITH {BARS},
s AS (SELECT stock_code, trade_date, CASE WHEN close < lag(close) OVER (PARTITION BY stock_code ORDER BY trade_date) THEN -volume ELSE volume END AS v FROM bars)
SELECT stock_code, trade_date, CAST(SUM(v) OVER (PARTITION BY stock_code ORDER BY trade_date) AS DOUBLE) AS obv FROM s""",
    "recursive_indicators": f"""WITH {RECURSIVE}
SELECT stock_code, trade_date, round("EMA_10", 4) + 0.0 AS ema_10, round("RSI_14", 4) + 0.0 AS rsi_14,
       round("MACD", 4) + 0.0 AS macd, round("MACD_Signal", 4) + 0.0 AS macd_signal FROM recursive_values""",
    "feature_frame": f"""WITH {FEATURES}
SELECT stock_code, trade_date, close, round("SMA_20" + 1e-9, 4) + 0.0 AS sma_20, round("EMA_10", 4) + 0.0 AS ema_10,
       round("MACD_Signal", 4) + 0.0 AS macd_signal, "OBV" AS obv, round(polarity, 4) + 0.0 AS polarity FROM features""",
    "forward_returns": f"""WITH {BARS}
SELECT stock_code, trade_date, (lead(close) OVER w - close) / close * 100.0 AS future_return
FROM bars WINDOW w AS (PARTITION BY stock_code ORDER BY trade_date)""",
    "training_sequences": f"""WITH {BARS}
SELECT stock_code, first_date, last_date, target_date, target, first_close, last_volume, last_weekday FROM (
  SELECT stock_code, trade_date AS first_date, lead(trade_date, 4) OVER w AS last_date, lead(trade_date, 5) OVER w AS target_date,
         lead(close, 5) OVER w AS target, close AS first_close, CAST(lead(volume, 4) OVER w AS DOUBLE) AS last_volume,
         CAST(isodow(lead(trade_date, 4) OVER w) - 1 AS DOUBLE) AS last_weekday
  FROM bars WINDOW w AS (PARTITION BY stock_code ORDER BY trade_date)) WHERE target_date IS NOT NULL""",
    "minmax_scaling": f"""WITH {BARS},
f AS (SELECT stock_code, min(close) AS c0, max(close) AS c1, min(volume) AS v0, max(volume) AS v1 FROM bars GROUP BY ALL)
SELECT stock_code, trade_date, round((close - c0) / (c1 - c0), 4) + 0.0 AS close_scaled,
       round((volume - v0)::DOUBLE / (v1 - v0)::DOUBLE, 4) + 0.0 AS volume_scaled,
       round((close - c0) / (c1 - c0) * (c1 - c0) + c0 + 1e-9, 4) + 0.0 AS close_again
FROM bars JOIN f USING (stock_code)""",
    "running_high_low": f"""WITH {TICKS}
SELECT symbol, event_ts, seq, price, max(price) OVER w AS running_high, min(price) OVER w AS running_low
FROM ticks WINDOW w AS (PARTITION BY symbol, CAST(event_ts AS DATE) ORDER BY event_ts, seq)""",
    "session_high_low": f"""WITH {TICKS},
q AS (SELECT *, CASE WHEN isodow(event_ts + INTERVAL 7 HOUR) < 6 AND hour(event_ts + INTERVAL 7 HOUR) BETWEEN 9 AND 14 THEN price END AS p FROM ticks)
SELECT symbol, event_ts, seq, price, max(p) OVER w AS running_high, min(p) OVER w AS running_low
FROM q WINDOW w AS (PARTITION BY symbol, CAST(event_ts AS DATE) ORDER BY event_ts, seq)""",
    "carried_apart": f"""WITH {TICKS},
q AS (SELECT symbol, event_ts, seq, CASE WHEN seq % 3 = 0 THEN change ELSE 0.0 END AS c, CASE WHEN seq % 5 = 0 THEN change_percent ELSE 0.0 END AS p FROM ticks),
l AS (SELECT *, last_value(CASE WHEN c <> 0 THEN {{'v': c, 't': event_ts}} END IGNORE NULLS) OVER w AS cs,
             last_value(CASE WHEN p <> 0 THEN {{'v': p, 't': event_ts}} END IGNORE NULLS) OVER w AS ps
      FROM q WINDOW w AS (PARTITION BY symbol ORDER BY event_ts, seq ROWS UNBOUNDED PRECEDING))
SELECT symbol, event_ts, seq, CASE WHEN event_ts < cs.t + INTERVAL 6 HOUR THEN cs.v ELSE coalesce(c, 0.0) END AS shown_change,
       CASE WHEN event_ts < ps.t + INTERVAL 6 HOUR THEN ps.v ELSE coalesce(p, 0.0) END AS shown_change_percent FROM l""",
    "carried_change": f"""WITH {TICKS},
q AS (SELECT symbol, event_ts, seq, CASE WHEN seq % 3 = 0 THEN change ELSE 0.0 END AS c, CASE WHEN seq % 3 = 0 THEN change_percent ELSE 0.0 END AS p FROM ticks),
l AS (SELECT *, last_value(CASE WHEN c <> 0 THEN {{'c': c, 'p': p, 't': event_ts}} END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY event_ts, seq ROWS UNBOUNDED PRECEDING) AS s FROM q)
SELECT symbol, event_ts, seq, CASE WHEN event_ts < s.t + INTERVAL 6 HOUR THEN s.c ELSE coalesce(c, 0.0) END AS shown_change,
       CASE WHEN event_ts < s.t + INTERVAL 6 HOUR THEN s.p ELSE coalesce(p, 0.0) END AS shown_change_percent FROM l""",
    "tick_direction": f"""WITH {TICKS},
q AS (SELECT symbol, event_ts, seq, floor(price / 20) AS price, day_volume, change, change_percent FROM ticks),
d AS (SELECT *, lag(price) OVER w AS p0, lag(day_volume) OVER w AS v0, lag(change) OVER w AS c0, lag(change_percent) OVER w AS r0 FROM q WINDOW w AS (PARTITION BY symbol ORDER BY event_ts, seq)),
s AS (SELECT *, CASE WHEN price > p0 THEN 'up' WHEN price < p0 THEN 'down' END AS p, CASE WHEN day_volume > v0 THEN 'up' WHEN day_volume < v0 THEN 'down' END AS v,
             CASE WHEN change > c0 THEN 'up' WHEN change < c0 THEN 'down' END AS c, CASE WHEN change_percent > r0 THEN 'up' WHEN change_percent < r0 THEN 'down' END AS r FROM d)
SELECT symbol, seq, last_value(p IGNORE NULLS) OVER w AS price_direction, last_value(v IGNORE NULLS) OVER w AS volume_direction,
       last_value(c IGNORE NULLS) OVER w AS change_direction, last_value(r IGNORE NULLS) OVER w AS change_percent_direction
FROM s WINDOW w AS (PARTITION BY symbol ORDER BY event_ts, seq ROWS UNBOUNDED PRECEDING)""",
    "collapsed_seconds": f"""WITH {TICKS}
SELECT symbol, date_trunc('hour', event_ts) AS second, arg_max(price, seq) AS price, arg_max(day_volume, seq) AS day_volume,
       arg_max_null(change, seq) AS change, arg_max_null(change_percent, seq) AS change_percent FROM ticks GROUP BY ALL""",
    "last_bars": f"""WITH {BARS} SELECT stock_code, trade_date, close FROM
(SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY trade_date DESC) AS rn FROM bars) WHERE rn <= 50""",
    "filled_gaps": f"""WITH {BARS},
h AS (SELECT stock_code, trade_date, CASE WHEN day(trade_date) > 20 THEN NULL WHEN day(trade_date) > 5 THEN close END AS a FROM bars)
SELECT stock_code, trade_date,
       coalesce(last_value(a IGNORE NULLS) OVER (PARTITION BY stock_code ORDER BY trade_date ROWS UNBOUNDED PRECEDING),
                first_value(a IGNORE NULLS) OVER (PARTITION BY stock_code ORDER BY trade_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS a,
       0.0::DOUBLE AS b FROM h""",
    "calendar_features": f"""WITH {BARS} SELECT stock_code, trade_date, CAST(day(trade_date) - 1 AS INTEGER) AS day,
CAST(isodow(trade_date) - 1 AS INTEGER) AS week, CAST(month(trade_date) - 1 AS INTEGER) AS month FROM bars""",
    "prediction_history": f"""WITH {PREDICTIONS},
t AS (SELECT stock_code, trade_date, close, trade_date - CASE isodow(trade_date) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS prev_date FROM
      (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY trade_date DESC) AS rn FROM bars) WHERE rn <= 30)
SELECT t.stock_code, t.trade_date AS prediction_date, CASE WHEN p.predicted_price IS NULL THEN 0 ELSE CAST(sign(p.predicted_price - q.close) AS INTEGER) END AS predicted_value,
       CAST(sign(t.close - q.close) AS INTEGER) AS actual_value, sign(p.predicted_price - q.close) = sign(t.close - q.close) AS is_correct
FROM t JOIN bars q ON q.stock_code = t.stock_code AND q.trade_date = t.prev_date
LEFT JOIN predictions p ON p.stock_code = t.stock_code AND p.prediction_date = t.trade_date""",
    "next_day_outlook": f"""WITH {PREDICTIONS},
l AS (SELECT stock_code, max(trade_date) AS last_date, arg_max(close, trade_date) AS last_close FROM bars GROUP BY ALL),
x AS (SELECT *, last_date + CASE isodow(last_date) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS prediction_date FROM l)
SELECT x.stock_code, last_date, last_close, x.prediction_date,
       CASE WHEN predicted_price > last_close THEN 'up' WHEN predicted_price < last_close THEN 'down' WHEN predicted_price IS NOT NULL THEN 'neutral' END AS trend
FROM x LEFT JOIN predictions p ON p.stock_code = x.stock_code AND p.prediction_date = x.prediction_date""",
    "candle_changes": f"""WITH {BARS} SELECT stock_code, trade_date, close - open AS candle_change,
CASE WHEN open > 0 THEN (close - open) / open * 100 ELSE 0.0 END AS candle_percent FROM bars""",
    # sort, limit, top-k
    "gainers_losers": f"""WITH {TICKS},
x AS (SELECT split_part(symbol, '.', 1) AS symbol, price, change_percent, coalesce(change_percent, 0.0) AS c FROM latest),
y AS (SELECT *, row_number() OVER (ORDER BY c DESC, symbol) AS up, row_number() OVER (ORDER BY c, symbol DESC) AS dn FROM x)
SELECT 'gainer' AS side, up AS position, symbol, price, change_percent FROM y WHERE up <= 5
UNION ALL SELECT 'loser', dn, symbol, price, change_percent FROM y WHERE dn <= 5""",
    "signed_movers": f"""WITH {BOARD}
(SELECT symbol, change_percent, 'gain' AS side FROM board WHERE change_percent > 0 ORDER BY change_percent DESC, symbol LIMIT 5)
UNION ALL (SELECT symbol, change_percent, 'loss' FROM board WHERE change_percent < 0 ORDER BY change_percent, symbol LIMIT 5)""",
    "top_volume": f"""WITH {BOARD}
SELECT symbol, volume, volume / 1000000.0::DOUBLE AS volume_millions, CAST(sign(change) AS INTEGER) AS direction,
       row_number() OVER (ORDER BY volume DESC, symbol) AS position FROM board WHERE volume > 0 ORDER BY volume DESC, symbol LIMIT 10""",
    "sector_top_volume": f"""WITH {BOARD}, {CODES} SELECT sector, symbol, volume, position FROM
(SELECT *, row_number() OVER (PARTITION BY sector ORDER BY volume DESC, symbol) AS position FROM board JOIN sectors ON stock_code = symbol) WHERE position <= 3""",
    "sector_ranking": f"""WITH {BOARD}, {CODES}, a AS (SELECT * FROM board JOIN sectors ON stock_code = symbol WHERE sector = 'ASIA')
SELECT symbol, price AS value, 'price' AS mode FROM a
UNION ALL SELECT symbol, CASE WHEN reference > 0 THEN (price - reference) / reference * 100 ELSE 0.0 END, 'percentage' FROM a""",
    "recent_news": f"""WITH {NEWS} SELECT {_NEWS_COLUMNS} FROM news WHERE date >= TIMESTAMP '1995-11-20 12:00:00'
ORDER BY date DESC, stock_code, article_id LIMIT 20""",
    "latest_predictions": f"WITH {PREDICTIONS} SELECT stock_code, prediction_date, predicted_price, confidence_score FROM newest",
    "predictions_history": f"WITH {PREDICTIONS} SELECT stock_code, prediction_date, predicted_price, confidence_score FROM predictions WHERE stock_code = 'S4'",
    "latest_snapshot": f"WITH {TICKS} SELECT symbol, price, change, change_percent, day_volume, last_size, exchange, event_ts FROM latest",
    "news_of_symbol": f"WITH {NEWS} SELECT article_id, stock_code, strftime(date, '%d-%m-%Y') AS date FROM news WHERE stock_code = 'S4'",
    "news_page": f"""WITH {NEWS} SELECT article_id, stock_code, date, (SELECT CAST(ceil(count(*) / 20.0) AS BIGINT) FROM news) AS total_pages
FROM news ORDER BY date DESC, doc_id LIMIT 20 OFFSET 40""",
    "best_models": f"""WITH {MODEL_RUNS} SELECT stock_code, trained_on, model_name, mse_loss, '["' || stock_code || '"]' AS alphas
FROM runs WHERE trained_on = DATE '1996-03-01'""",
    "training_history": f"WITH {MODEL_RUNS} SELECT model_name, trained_on, stock_code, model_type, stock_code AS formulas FROM runs",
    "trade_tape": f"""WITH {TICKS} SELECT strftime(event_ts + INTERVAL 7 HOUR, '%H:%M:%S') AS time, price, last_size, change, seq
FROM ticks WHERE symbol = 'S3.VN'""",
    # scalar functions
    "scalar_functions": f"""WITH {RAW}
SELECT seq, floor(price / 7 * 100.0 + 0.5) / 100.0 AS rounded, floor(-price / 8 * 100.0 + 0.5) / 100.0 AS rounded_negative,
       'S' || n::VARCHAR AS code, 'S' || n::VARCHAR AS base, nullif(last_size, 0) AS size_or_null,
       price + floor(price * 0.07 + 0.5) AS ceiling, price - floor(price * 0.07 + 0.5) AS floor,
       floor(price * 1.07 + 0.5) AS ceiling_scaled, floor(price * 0.93 + 0.5) AS floor_scaled,
       CASE WHEN price > 20 THEN 'up' WHEN price < 20 THEN 'down' ELSE 'neutral' END AS trend,
       CASE WHEN price > 20 THEN 1 WHEN price < 20 THEN -1 ELSE 0 END AS trend_sign,
       1.0::DOUBLE / (1.0::DOUBLE + price) AS confidence,
       CASE WHEN last_size <> 50 THEN (price - last_size) / (50.0::DOUBLE - last_size) * 100.0 END AS range_position,
       CASE WHEN last_size > 50 THEN last_size END AS latency_ms,
       CASE seq % 5 WHEN 0 THEN TRUE WHEN 2 THEN TRUE WHEN 3 THEN TRUE ELSE FALSE END AS flag,
       symbol || '|' || CAST(event_ts AS DATE)::VARCHAR || '|' || seq::VARCHAR AS article_key,
       'Real Estate' AS label, last_size <= 50 AS finite
FROM raw_ticks""",
    "parsed_times": f"""WITH {RAW}, f AS (SELECT *, seq % 6 AS m, date_trunc('second', event_ts) AS s, date_trunc('millisecond', event_ts) AS ms FROM raw_ticks)
SELECT seq, CASE m WHEN 0 THEN ms WHEN 1 THEN s WHEN 2 THEN s WHEN 3 THEN s END AS tick_time,
       CASE m WHEN 0 THEN ms - INTERVAL 7 HOUR WHEN 1 THEN s - INTERVAL 7 HOUR WHEN 2 THEN s WHEN 3 THEN s WHEN 4 THEN date_trunc('day', event_ts)::TIMESTAMP END AS csv_time,
       CAST(event_ts AS DATE) AS trade_date, date_trunc('minute', event_ts) AS minute FROM f""",
    "calendar_functions": f"""WITH {CALENDAR}
SELECT seq, wd < 5 AND h >= 9 AND h < 15 AS trading,
       CASE WHEN wd < 5 AND h >= 9 AND h < 15 THEN d + INTERVAL 15 HOUR WHEN wd >= 5 THEN d + CAST(7 - wd AS INTEGER) + INTERVAL 9 HOUR
            WHEN h < 9 THEN d + INTERVAL 9 HOUR ELSE d + 1 + INTERVAL 9 HOUR END - INTERVAL 7 HOUR AS next_edge,
       CAST(d - CAST(CASE WHEN wd >= 5 THEN wd - 4 WHEN h >= 9 THEN 0 WHEN wd = 0 THEN 3 ELSE 1 END AS INTEGER) AS DATE) AS latest_trading_date,
       CAST(CASE WHEN h < 9 THEN d - CAST(CASE wd WHEN 5 THEN 2 WHEN 6 THEN 3 WHEN 0 THEN 4 ELSE 1 END AS INTEGER)
            ELSE d - CAST(CASE WHEN wd >= 5 THEN wd - 3 WHEN wd = 0 THEN 3 ELSE 1 END AS INTEGER) END AS DATE) AS reference_date,
       CAST(ud - CASE uwd WHEN 0 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS DATE) AS prev_weekday,
       CAST(ud + CASE uwd WHEN 4 THEN 3 WHEN 5 THEN 2 ELSE 1 END AS DATE) AS next_weekday
FROM local_times""",
    "trading_days": f"WITH {BARS} SELECT stock_code, trade_date FROM bars WHERE isodow(trade_date) < 6 AND day(trade_date) <> 1",
    "formula_checks": f"""WITH {BARS} SELECT stock_code, f AS formula, e AS expression, p AS problem
FROM (SELECT DISTINCT stock_code FROM bars), (VALUES {CHECKED}) AS v(f, e, p)""",
    "evaluated_formula": f"""WITH {BARS} SELECT stock_code, trade_date,
CASE WHEN close <> open THEN (high - low) / (close - open) * volume + 2.5::DOUBLE + CASE WHEN close >= open THEN 1.0 ELSE 0.0 END END AS value FROM bars""",
    # factors
    "alpha_values": f"WITH {ALPHAS} SELECT stock_code, trade_date, formula, round(value, 3) + 0.0 AS value FROM alphas",
    "many_formulas": f"""WITH {FEATURES}
SELECT stock_code, 'close * ' || k::VARCHAR || ' - open' AS formula, count(*) AS n_values, round(max(close * k - open), 2) + 0.0 AS highest
FROM features, (SELECT unnest(range(1, 151)) AS k) GROUP BY ALL""",
    "alpha_scores": f"WITH {ALPHAS} SELECT stock_code, formula, round(rank_ic, 4) + 0.0 AS rank_ic, n_samples FROM scores",
    "alpha_pvalues": f"""WITH {ALPHAS}, s AS (SELECT *, abs(rank_ic) AS a, 1 - rank_ic * rank_ic AS x FROM scores),
p AS (
  SELECT *, CASE WHEN rank_ic IS NULL THEN NULL WHEN a >= 1 THEN 1.0::DOUBLE
    WHEN n_samples % 2 = 0 THEN a * list_sum([exp(lgamma(k + 0.5) - lgamma(k + 1.0) + k * ln(x)) for k in range(0, (n_samples - 2) // 2)]) / sqrt(pi())
    ELSE 2 / pi() * (asin(a) + a * sqrt(x) * list_sum([exp(lgamma(k + 1.0) - lgamma(k + 1.5) + k * ln(x)) for k in range(0, (n_samples - 3) // 2)]) * sqrt(pi()) / 2) END AS inside
  FROM s)
SELECT stock_code, formula, round(greatest(1 - inside, 0), 6) + 0.0 AS pvalue FROM p""",
    "best_alphas": f"""WITH {ALPHAS} SELECT stock_code, formula, position FROM
(SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY rank_ic DESC NULLS LAST, formula) AS position FROM scores) WHERE position <= 5""",
    "linear_predictions": f"""WITH {LINEAR}
SELECT stock_code, target_date, round(y * span + low + 1e-6, 2) + 0.0 AS target, round((slope * x + intercept) * span + low + 1e-6, 2) + 0.0 AS predicted
FROM windows JOIN fits USING (stock_code) JOIN scaling USING (stock_code) JOIN cuts USING (stock_code) WHERE target_date > cut""",
    "linear_losses": f"""WITH {LINEAR}
SELECT stock_code, round(avg((slope * x + intercept - y) ** 2), 6) + 0.0 AS mse_loss, any_value(n_windows) AS n_windows,
       round(any_value(slope), 6) + 0.0 AS slope, round(any_value(intercept), 6) + 0.0 AS intercept
FROM windows JOIN fits USING (stock_code) JOIN cuts USING (stock_code) WHERE target_date > cut GROUP BY stock_code""",
    "champions": f"""WITH {MODEL_RUNS}
SELECT n.stock_code, CASE WHEN o.mse_loss < n.mse_loss THEN o.model_name ELSE n.model_name END AS model_name,
       NOT coalesce(o.mse_loss < n.mse_loss, FALSE) AS new_model_used,
       CASE WHEN o.mse_loss < n.mse_loss THEN o.mse_loss ELSE n.mse_loss END AS mse_loss,
       1.0::DOUBLE / (1.0::DOUBLE + CASE WHEN o.mse_loss < n.mse_loss THEN o.mse_loss ELSE n.mse_loss END) AS confidence
FROM runs n LEFT JOIN runs o ON o.stock_code = n.stock_code AND o.trained_on = DATE '1996-02-01' WHERE n.trained_on = DATE '1996-03-01'""",
    "saveable_predictions": f"WITH {PREDICTIONS} SELECT stock_code, prediction_date, predicted_price FROM predictions WHERE day(prediction_date) <> 1",
    "scored_articles": f"""WITH {NEWS},
w AS (SELECT article_id, is_pdf, regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}_]+') AS t FROM news),
c AS (SELECT *, len(list_filter(t, lambda x: x IN ('the', 'and', 'de', 'la', 'der'))) AS g, len(list_filter(t, lambda x: x IN ('of', 'in', 'le', 'el', 'und'))) AS b FROM w)
SELECT article_id, is_pdf, CASE WHEN is_pdf AND article_id::INT % 3 <> 0 THEN (length(article_id) + 2) % 3 - 1.0 WHEN g + b = 0 THEN 0.0 ELSE round((g - b)::DOUBLE / (g + b)::DOUBLE, 4) + 0.0 END AS score FROM c""",
    # streaming
    "stream_daily": f"WITH {DAILY} SELECT * FROM daily",
    "stream_minute": f"""WITH {TICKS}, b AS ({_bars_over("1 minute", "valid").replace("LABEL", "'1m'")})
SELECT symbol, bucket_date, interval, ts, floor(open * 100.0 + 0.5) / 100.0 AS open, floor(high * 100.0 + 0.5) / 100.0 AS high,
       floor(low * 100.0 + 0.5) / 100.0 AS low, floor(close * 100.0 + 0.5) / 100.0 AS close, volume FROM b""",
    "stream_latest": f"""WITH {TICKS}
SELECT symbol, floor(price * 100.0 + 0.5) / 100.0 AS price, floor(change_percent * 100.0 + 0.5) / 100.0 AS change_percent, day_volume, event_ts, seq
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY event_ts DESC, seq DESC) AS r FROM valid) WHERE r = 1""",
    "stream_ticks": f"""WITH {TICKS}
SELECT symbol, "timestamp", floor(price * 100.0 + 0.5) / 100.0 AS price, floor(change * 100.0 + 0.5) / 100.0 AS change, day_volume, seq
FROM (SELECT *, row_number() OVER (PARTITION BY symbol, "timestamp" ORDER BY event_ts DESC, seq DESC) AS r FROM valid) WHERE r = 1""",
    "stream_changes": f"""WITH {TICKS},
l AS (SELECT *, lag(price) OVER w AS p0, lag(change) OVER w AS c0, lag(change_percent) OVER w AS r0, lag(day_volume) OVER w AS v0, lag(last_size) OVER w AS s0
      FROM valid WINDOW w AS (PARTITION BY symbol ORDER BY event_ts, seq))
SELECT split_part(symbol, '.', 1) AS symbol, seq, CASE WHEN price IS DISTINCT FROM p0 THEN price END AS price,
       CASE WHEN change IS DISTINCT FROM c0 THEN change END AS change, CASE WHEN day_volume IS DISTINCT FROM v0 THEN day_volume END AS day_volume,
       CASE WHEN last_size IS DISTINCT FROM s0 THEN last_size END AS last_size, 0::BIGINT AS latency_ms
FROM l WHERE price IS DISTINCT FROM p0 OR change IS DISTINCT FROM c0 OR change_percent IS DISTINCT FROM r0 OR day_volume IS DISTINCT FROM v0 OR last_size IS DISTINCT FROM s0""",
    "late_ticks": f"""WITH {TICKS}, m AS (SELECT max(event_ts) AS seen FROM valid WHERE seq % 4 <> 0)
SELECT sink, symbol, event_ts, seq, price FROM valid, m, (VALUES ('minute', INTERVAL 1 MINUTE, INTERVAL 10 MINUTE), ('daily', INTERVAL 1 DAY, INTERVAL 1 DAY)) v(sink, width, delay)
WHERE seq % 4 = 0 AND market_hours = 1 AND time_bucket(width, event_ts, TIMESTAMP '2000-01-01') + width <= seen - delay""",
    "stream_running_daily": _running("1 DAY", "1 DAY", "arg_max(day_volume, place) OVER w"),
    "stream_running_minute": _running("1 MINUTE", "10 MINUTE", "(sum(last_size) OVER w)::BIGINT"),
    "gated_ticks": f"""WITH {RAW} SELECT symbol, seq, price FROM raw_ticks
WHERE isodow(event_ts + INTERVAL 7 HOUR) < 6 AND hour(event_ts + INTERVAL 7 HOUR) BETWEEN 9 AND 14""",
    "live_movers": f"""WITH {TICKS},
x AS (SELECT split_part(symbol, '.', 1) AS symbol, price, day_volume, coalesce(change_percent, 0.0) AS c FROM latest),
y AS (SELECT *, row_number() OVER (ORDER BY c DESC, symbol) AS up, row_number() OVER (ORDER BY c, symbol DESC) AS dn FROM x)
SELECT 'gainer' AS side, up AS position, symbol, price, day_volume FROM y WHERE up <= 5
UNION ALL SELECT 'loser', dn, symbol, price, day_volume FROM y WHERE dn <= 5""",
    # metrics
    "latency_histogram": f"WITH {HISTOGRAM} SELECT symbol, le, bucket_count, events, latency_sum FROM bucket_rows",
    "counter_rates": f"WITH {stepped_sums(3600, 1800)} SELECT symbol, at_time, round(coalesce(increase, 0.0) / 3600, 6) + 0.0 AS rate FROM sums",
    "total_rate": f"""WITH {stepped_sums(3600, 3600)}
SELECT at_time, round(sum(coalesce(increase, 0.0) / 3600), 6) + 0.0 AS rate FROM sums GROUP BY at_time""",
    "latency_quantiles": f"""WITH {HISTOGRAM},
q AS (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS q),
o AS (SELECT symbol, bound, bucket_count AS c, coalesce(lag(bucket_count) OVER w, 0) AS c0, coalesce(lag(bound) OVER w, 0.0) AS b0,
             max(bucket_count) OVER (PARTITION BY symbol) AS total FROM bucket_rows WINDOW w AS (PARTITION BY symbol ORDER BY bound)),
h AS (SELECT *, row_number() OVER (PARTITION BY symbol, q ORDER BY bound) AS rn FROM o, q WHERE c >= total * q)
SELECT symbol, q, round(CASE WHEN isinf(bound) THEN 5000.0 ELSE b0 + (bound - b0) * ((total * q - c0) / (c - c0)) END, 4) + 0.0 AS quantile FROM h WHERE rn = 1""",
    "mean_latency": f"""WITH {CHANGES} SELECT symbol, {grid("ts", 3600)} AS at_time, round(avg(latency_ms), 4) + 0.0 AS mean FROM change_samples GROUP BY ALL""",
    "guarded_ratios": f"""WITH {CHANGES} SELECT symbol, {grid("ts", 86400)} AS at_time,
round(CASE WHEN count(*) > 10 THEN greatest(1.0 - count(*) FILTER (WHERE latency_ms > 200) / count(*)::DOUBLE, 0.0) ELSE 0.0 END, 4) + 0.0 AS ratio
FROM change_samples GROUP BY ALL""",
    "counter_changes": f"WITH {stepped_sums(7200, 3600)} SELECT symbol, at_time, SUM(changes)::BIGINT AS changes, SUM(resets)::BIGINT AS resets FROM sums GROUP BY ALL",
    "outliers": f"""WITH {stepped_sums(3600, 3600)}, r AS (SELECT symbol, at_time, coalesce(increase, 0.0) / 3600 * 3600 AS rate FROM sums),
z AS (SELECT *, abs(rate - avg(rate) OVER (PARTITION BY at_time)) / (stddev_pop(rate) OVER (PARTITION BY at_time) + 10.0) AS z FROM r)
SELECT symbol, at_time, round(rate, 4) + 0.0 AS rate, round(z, 4) + 0.0 AS z FROM z WHERE z > 1.5""",
    "offset_deltas": f"""WITH {SAMPLES},
g AS (SELECT symbol, {grid("ts", 1800)} AS at_time, arg_max(value, row(ts, seq)) AS value FROM samples GROUP BY ALL)
SELECT symbol, at_time, value - coalesce(last_value(value) OVER (PARTITION BY symbol ORDER BY at_time
       RANGE BETWEEN INTERVAL 10800 SECOND PRECEDING AND INTERVAL 3600 SECOND PRECEDING), 0.0) AS delta FROM g""",
    "held_alerts": f"""WITH {SAMPLES},
f AS (SELECT *, count(*) FILTER (WHERE NOT value < 400) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS island FROM samples)
SELECT symbol, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n_samples, min(ts) + INTERVAL 7200 SECOND AS fired_at
FROM f WHERE value < 400 GROUP BY symbol, island HAVING max(ts) >= min(ts) + INTERVAL 7200 SECOND""",
    "absent_instances": f"""WITH {SAMPLES} SELECT symbol AS instance FROM samples GROUP BY symbol HAVING max(value) <= 1000""",
    "per_unit": f"""WITH {TICKS}, u AS (SELECT symbol, count(*) AS units FROM ticks GROUP BY ALL)
SELECT symbol AS instance, CAST(day_volume AS DOUBLE) AS value, units, day_volume::DOUBLE / units::DOUBLE AS per_unit FROM latest JOIN u USING (symbol)""",
    "log_rates": f"""WITH {CHANGES} SELECT module, date_trunc('hour', ts) + INTERVAL 1 HOUR AS at_time, round(count(*) / 3600.0::DOUBLE, 6) + 0.0 AS rate
FROM change_samples WHERE module IN ('error', 'click') GROUP BY ALL""",
    "last_event_times": f"""WITH {stepped_sums(3600, 1800).replace("CAST(day_volume AS DOUBLE) AS value", "floor(CAST(day_volume AS DOUBLE) / 500) AS value")}
SELECT symbol, at_time, max(CASE WHEN changes > 0 THEN at_time END) OVER (PARTITION BY symbol ORDER BY at_time ROWS UNBOUNDED PRECEDING) AS last_event
FROM (SELECT symbol, at_time, SUM(changes) AS changes FROM sums GROUP BY ALL)""",
    "run_progress": f"""WITH {CHANGES}
SELECT symbol, CAST(ts AS DATE) AS day, round(CASE WHEN max(CASE WHEN module = 'error' THEN 0 ELSE 1 END) > 0 THEN 1.0 ELSE 0.0 END
  * CASE WHEN max(seq % 50) <= 0 THEN 0.0 ELSE SUM(seq % 7)::DOUBLE / nullif(SUM(seq % 50), 0)::DOUBLE END, 6) + 0.0 AS progress
FROM change_samples GROUP BY ALL""",
    # jobs
    "warehouse_daily": f"WITH {DAILY} SELECT split_part(symbol, '.', 1) AS stock_code, trade_date, open, high, low, close, volume, change FROM daily",
    "warehouse_news": f"WITH {NEWS} SELECT stock_code, news_date, article_id, length(content)::BIGINT AS content_chars, sentiment_score FROM news",
    "warehouse_dim": f"""WITH {DAILY}, {NEWS} SELECT DISTINCT stock_code, 'NASDAQ' AS exchange, 1 AS quote_type
FROM (SELECT split_part(symbol, '.', 1) AS stock_code FROM daily UNION SELECT stock_code FROM news)""",
    "ingested_news": """SELECT page_id::VARCHAR AS article_id, 'S' || (page_id % 10)::VARCHAR AS stock_code, url AS link,
TIMESTAMP '1995-12-20 12:00:00' AS date, FALSE AS is_pdf, TIMESTAMP '1995-12-20 12:00:00' AS crawled_at FROM pages""",
}
ORACLE["serving_report_breadth"] = ORACLE["market_breadth"]
for _name, _twin in {
    "board": "market_board",
    "prediction_trend": "prediction_trends",
    "accuracy": "prediction_accuracy",
    **{n: n for n in ("gainers_losers", "signed_movers", "top_volume", "sector_volume")},
}.items():
    ORACLE[f"serving_report_{_name}"] = ORACLE[_twin]
# the report names up to 15 leaders of a sector
ORACLE["serving_report_sector_leaders"] = ORACLE["sector_top_volume"].replace("position <= 3", "position <= 15")
