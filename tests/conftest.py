import pytest

from answerlake import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session.build(
        "answerlake-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "6g",
            # a test counts executions of its query: in the whole suite the default of 1000 forgets earlier ones
            "spark.sql.ui.retainedExecutions": "10000",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
