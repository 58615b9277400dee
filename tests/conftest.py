import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quotemill.session import build_session  # noqa: E402

UTC = dt.timezone.utc


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "quotemill-tests",
        "4",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as plain tuples, sorted."""

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)

    return collect


@pytest.fixture(scope="session")
def make_ticks(spark):
    """Ticks from (symbol, time, price, size[, day_volume, market_hours])."""
    from quotemill import schemas

    def build(*items):
        out = []
        for seq, (symbol, at, price, size, *rest) in enumerate(items):
            ts = dt.datetime.fromisoformat(at)
            volume = rest[0] if rest else size
            session = rest[1] if len(rest) > 1 else 1
            ms = str(int(ts.replace(tzinfo=UTC).timestamp() * 1000))
            change = rest[2] if len(rest) > 2 else 0.0
            out.append((symbol, float(price), ms, "HSX", 1, session, change, volume, change, size, "2", int(ms), ts, seq))
        return spark.createDataFrame(out, schemas.TIMED_TICK)

    return build
