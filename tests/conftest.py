import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from peerscope.operators.scale import clear_scratch
    from peerscope.session import build_session

    s = build_session("tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    clear_scratch(s)
    s.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-")


@pytest.fixture
def hot(spark):
    """Make every key above five rows hot, so the splitting plans are used."""
    spark.conf.set("spark.peerscope.hotRows", "5")
    yield
    spark.conf.unset("spark.peerscope.hotRows")
