import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from verdigris.session import session

    shared = tmp_path_factory.mktemp("shared")
    spark = session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="3g",
        spark__checkpoint__dir=f"file://{shared}",
        spark__sql__warehouse__dir=str(shared / "warehouse"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
