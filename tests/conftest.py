import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

import pytest  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from tessera.session import session

    made = session(4, **{"spark.sql.shuffle.partitions": "4"})
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
