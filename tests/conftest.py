import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lexmill.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, app="lexmill-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def docs(spark):
    from lexmill.plans.queries import documents

    return documents(spark, DATA).cache()


@pytest.fixture(scope="session")
def split(docs):
    from lexmill.operators.prepare import split_pair

    return split_pair(docs, "text")


@pytest.fixture(scope="session")
def model(spark, split, tmp_path_factory):
    from lexmill.operators.bayes import fit_bayes

    return fit_bayes(split[0], str(tmp_path_factory.mktemp("model")), 4)
