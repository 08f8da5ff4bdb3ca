import tempfile

import pytest

from popspark.session import session


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    out = session("local[4]", 4, **{"spark.driver.memory": "6g", "spark.ui.enabled": "false", "spark.local.dir": folder, "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.checkpoint.dir": f"{folder}/checkpoints"})
    out.sparkContext.setLogLevel("ERROR")
    return out
