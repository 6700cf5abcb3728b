import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import session

    s = session(4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.conf.set("spark.sql.codegen.wholeStage", "false")  # tables of a few rows: compiling takes longer than running
    s.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    return s
