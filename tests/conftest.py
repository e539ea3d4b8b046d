import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelwright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=folder,
        spark__driver__memory="4g",
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def panel_pdf():
    """Four entities, 60 monthly rows each, with gaps in the calendar."""
    rng = np.random.default_rng(7)
    out = []
    for e in "ABCD":
        months = np.sort(rng.choice(np.arange(90), 60, replace=False))
        y = np.zeros(60)
        for i in range(1, 60):
            y[i] = 0.6 * y[i - 1] + rng.normal()
        x = rng.normal(size=60) + 0.3 * y
        z = 0.8 * x + 0.4 * rng.normal(size=60)
        out.append(pd.DataFrame({"industry": e, "year": months, "y": y + 5, "x": x, "z": z}))
    return pd.concat(out, ignore_index=True)


@pytest.fixture(scope="session")
def panel(spark, panel_pdf):
    # Shuffled row order and partitioning: results must not depend on either.
    mixed = panel_pdf.sample(frac=1, random_state=3)
    return spark.createDataFrame(mixed).repartition(7).cache()
