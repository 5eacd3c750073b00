import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def small_panel(spark):
    """Three subjects of different length, four parts, with zeros and one absent part."""
    import numpy as np

    rng = np.random.default_rng(7)
    cells, meta = [], []
    for s, length in (("a", 37), ("b", 24), ("c", 30)):
        base = np.cumsum(rng.normal(0, 0.3, (length, 4)), axis=0) + [1.0, 1.5, 2.0, 2.5]
        t = np.cumsum(rng.uniform(0.5, 1.5, length))
        counts = rng.poisson(np.exp(np.clip(base, -2, 5)))
        if s == "c":
            counts[:, 0] = 0
        for k in range(length):
            meta.append((f"{s}|{k}", s, float(t[k])))
            cells += [(f"{s}|{k}", f"t{p}", float(counts[k, p])) for p in range(4) if counts[k, p] > 0]
    panel = spark.createDataFrame(cells, "sample string, taxon string, count double")
    samples = spark.createDataFrame(meta, "sample string, subject string, time double")
    return panel, samples
