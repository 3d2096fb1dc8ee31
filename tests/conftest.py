import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from termforge.session import local_session

    return local_session(4, "tests", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.driver.memory": "4g"})


@pytest.fixture(scope="session")
def toy(spark):
    """Eight short documents; model.py tells what is expected of them."""
    from model import TEXTS

    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
