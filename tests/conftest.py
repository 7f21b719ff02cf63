from __future__ import annotations

import logging
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import session

    logging.disable(logging.CRITICAL)
    made = session("local[4]", 4, **{"spark.driver.memory": "4g", "spark.sql.adaptive.coalescePartitions.enabled": "true"})
    yield made
    made.stop()
