import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from checks.verify import session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session("4", "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def hot(spark):
    """Limits so small that every helper takes its split plan."""
    spark.conf.set("spark.tracklake.hotRows", "6")
    spark.conf.set("spark.tracklake.pieceRows", "8")
    yield spark
    spark.conf.unset("spark.tracklake.hotRows")
    spark.conf.unset("spark.tracklake.pieceRows")
