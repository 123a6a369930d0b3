import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lodestone.session import local_session

    session = local_session(cpus=8, partitions=4, memory="6g")
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    yield session
    session.stop()
