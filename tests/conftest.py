import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from loomery.session import build_session

    conf = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"}
    conf["spark.sql.autoBroadcastJoinThreshold"] = "1m"
    return build_session("loomery-tests", "local[4]", **conf)
