import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewatch.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def people(spark):
    """Harbour pilots: one NULL in name, two in mail, three in phone."""
    return spark.createDataFrame(
        [
            (11, "Ines Duarte", None, "+351 21"),
            (12, "Tom Okafor", "tom@harbour.test", None),
            (13, None, "watch@harbour.test", "+234 80"),
            (14, "Mei Tan", "mei@harbour.test", None),
            (15, "Lars Holm", None, None),
        ],
        "id int, name string, email string, phone string",
    )


@pytest.fixture
def repeated(spark):
    """Five readings of three tide gauges, two of them sent twice."""
    return spark.createDataFrame(
        [(4, "north pier", 71), (9, "lock", 35), (9, "lock", 35), (4, "north pier", 71), (6, "buoy 6", 52)],
        "id int, name string, value int",
    )


@pytest.fixture
def moorings(spark):
    """Nine berth bookings with faults of every kind."""
    return spark.createDataFrame(
        [
            (101, "Aurora", "desk@aurora.test", 4, 310.5),
            (102, "Borealis", "crew-at-borealis", 2, 120.0),
            (103, "", "office@cirrus.test", 9, None),
            (None, "Dorado", None, 3, 88.0),
            (105, "Estrella", "e@estrella.test", 400, -15.0),
            (105, "Estrella", "e@estrella.test", 400, -15.0),
            (107, None, "g@gale.test", None, 42.0),
            (108, "Halcyon", None, 6, 75.25),
            (109, "Iris", "iris@iris.test", -1, 60.0),
        ],
        "id int, name string, email string, age int, salary double",
    )
