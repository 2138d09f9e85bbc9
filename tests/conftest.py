import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dayweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("DAYWEAVE_DRIVER_MEMORY", "4g")
    session = local_session("tests", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def days(spark):
    """Two entities, 400 days of seeded noise with gaps."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    parts = []
    for name in ("ann", "bob"):
        n = 400
        t = np.arange(n)
        a = np.round(np.abs(rng.normal(5, 2, n)) + 2 * np.sin(t / 15), 3)
        pain = np.round(2 + np.sin(t / 20 + 1) + rng.normal(0, 0.4, n), 3)
        gaps = rng.random(n) < 0.05
        parts.append(
            pd.DataFrame(
                {
                    "entity": name,
                    "day": pd.date_range("2020-01-01", periods=n).date,
                    "pos": t,
                    "a": a,
                    "b": np.round(a * 0.5 + rng.normal(0, 1, n), 3),
                    "pain": np.where(gaps, np.nan, pain),
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="session")
def series(spark, days):
    from dayweave.functions.expressions import nan_to_null

    return nan_to_null(spark.createDataFrame(days)).cache()
