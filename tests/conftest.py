import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from roadlens.session import session


@pytest.fixture(scope="session")
def spark():
    found = session(
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.sql.files.maxPartitionBytes": "4m"},
    )
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
