import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidemark.session import build_session  # noqa: E402

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows from a DDL schema and tuples; timestamps may be given as text."""
    def build(schema: str, *rows: tuple):
        from pyspark.sql import functions as F
        from pyspark.sql import types as T
        wanted = T._parse_datatype_string(schema)
        raw = T.StructType([T.StructField(f.name, T.StringType() if isinstance(
            f.dataType, T.TimestampType) else f.dataType) for f in wanted])
        df = spark.createDataFrame(list(rows), raw)
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])
    return build


def dicts(df):
    return [row.asDict(recursive=True) for row in df.collect()]
