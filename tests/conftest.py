import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("trailmine-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


HEADER = "Session ID\tUser\tIP\tType\tTime\tQuery\tTitle"


def search(session, query, time="2011-01-01 09:00:00", title="x", kind="Search/Lucene", more=""):
    return f"{session}\tu\tip\t{kind}\t{time}\t{query}\t{title}{more}"


def topic(session, title, time="2011-01-01 09:01:00", kind="TopicView/full"):
    return f"{session}\tu\tip\t{kind}\t{time}\t\t{title}"


@pytest.fixture
def write_log(tmp_path):
    def write(files: dict[str, list[str]], folder: str = "raw") -> str:
        target = tmp_path / folder
        for name, lines in files.items():
            path = target / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text("".join(line + "\n" for line in lines))
        return str(target)

    return write
