import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from colloquy import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture
def turn_table(spark):
    """Build a turn table from ``{conv_id: [text, ...]}``."""
    def build(dialogs):
        rows = [(c, t, text) for c, texts in dialogs.items()
                for t, text in enumerate(texts)]
        return spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")
    return build
