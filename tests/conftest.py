import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from almanac.schemas import LOG  # noqa: E402
from almanac.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=8, shuffle_partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture
def make_log(spark):
    """Log rows from short dicts; everything left out is null."""

    def make(rows):
        full = []
        for number, row in enumerate(rows):
            row = {"subject_id": 1, "entry_id": number, **row}
            if isinstance(row.get("date"), str):
                row["date"] = dt.date.fromisoformat(row["date"])
            full.append(tuple(row.get(f.name) for f in LOG))
        return spark.createDataFrame(full, LOG)

    return make
