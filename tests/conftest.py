import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tamis-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """(path, text) pairs as a file relation."""
    from pyspark.sql import functions as F

    from tamis.sources.files import from_table

    def make(*rows):
        df = spark.createDataFrame(list(rows), "p string, t string")
        return from_table(df, F.col("p"), F.col("t"))

    return make
