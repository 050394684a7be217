import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests"), os.path.join(ROOT, "tests", "llm")]
# the tasks' Python finds the package here, wherever the tests are started
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

import pytest  # noqa: E402
from rough_rows import ROUGH, ROUGH_SCHEMA, SF  # noqa: E402


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def rough(spark):
    """The rough rows with columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(ROUGH, ROUGH_SCHEMA)
    clash = ["score", "kept", "key", "node", "component_id", "size", "_size", "file", "ordinal", "family", "item_id", "words", "target", "spans"]
    return frame.withColumns({c: F.lit("x") for c in clash})


@pytest.fixture(scope="session")
def nothing(rough):
    return rough.limit(0)
