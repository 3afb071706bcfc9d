import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from regiopanel.session import get_session
    s = get_session("local[8]", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def seed(spark):
    """Seed deployment after recompute -> trend forecast (run 1) -> recompute."""
    from regiopanel.plans import jobs as PL
    from tests.seed import seed_store
    st0 = seed_store(spark)
    before = PL.recompute(st0)
    st1 = PL.with_forecast_run(st0, PL.run_forecast(st0, 1, 12, "seasonal_trend_v2"))
    after = PL.recompute(st1)
    return {"store0": st0, "before": before, "store": st1, "after": after}
