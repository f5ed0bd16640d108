import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import awkward_docs as _docs  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return _docs.table(spark).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return _docs.empty(spark)


@pytest.fixture(scope="session")
def folder(docs, nothing, tmp_path_factory):
    """The awkward table, and an empty one, as data sets for the registered queries."""
    top = tmp_path_factory.mktemp("sf")
    for name, df in (("full", docs), ("none", nothing)):
        df.write.parquet(str(top / name / "documents.parquet"))
        labels = docs.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")
        labels.write.parquet(str(top / name / "labels.parquet"))
    return top
