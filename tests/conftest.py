import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from statloom.runtime import share_package

    share_package(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fixtures(tmp_path_factory):
    """Small CSV files, by name."""
    root = tmp_path_factory.mktemp("fixtures")
    content = {
        "firms.csv": "id,name,revenue,year\n1,Acme,1000,2017\n2,Beta,2000,2018\n3,Gamma,1500,2017\n4,Delta,3000,2018\n5,Epsilon,500,2018\n",
        "panel.csv": "id,name,revenue_2017,revenue_2018,old_revenue_2019\n1,Acme,1000,1100,9\n2,Beta,2000,2200,9\n3,Gamma,1500,,9\n",
        "panel_ts.csv": "id,year,revenue\n1,2015,100\n1,2016,120\n1,2017,150\n1,2019,200\n2,2016,500\n2,2017,550\n2,2018,600\n",
        "yeargdp.csv": "year,gdp\n2017,100\n2018,110\n2019,120\n",
        "nulls.csv": "g,x\na,1\na,\nb,\n,5\n,7\n",
    }
    for name, text in content.items():
        (root / name).write_text(text)
    return root
