import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def users(spark):
    """Fifty users as text cells: gaps in age and in days since login, a tie for the mode."""
    rows = []
    for i in range(50):
        age = "None" if i == 40 else str(22 + i * 7 % 28)
        # 2, 4 and 5 are equally frequent; 2 is seen first
        days = "" if i in (4, 13) else str([2, 5, 30, 1 if i < 20 else 33, 4, 45, 7, 6, 25, 8][i % 10])
        rows.append((
            str(i + 1), f"Given{i} Family{i * 7}", age, ["Female", "Male"][i % 2],
            ["New York", "California", "Texas", "Florida"][i % 4], f"{90 + i * 15.5:.2f}", str(12 + i * 3 % 80),
            "false" if i % 5 == 2 else "true", days,
        ))
    names = "user_id name age gender location purchase_amount login_count is_active last_login_days".split()
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
