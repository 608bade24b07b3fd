import pytest

from quern.workspace import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(4, "tests", spark__checkpoint__dir="file://" + str(tmp_path_factory.mktemp("shared")))
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()
