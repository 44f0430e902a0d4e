import hashlib

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows, columns="doc_id long, text string"):
        return spark.createDataFrame(rows, columns)

    return make


@pytest.fixture(scope="session")
def sha():
    return lambda text: hashlib.sha256(text.encode()).hexdigest()
