from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cellshift.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": 4, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(spark):
    """Seven samples and three proteins with known answers."""
    from cellshift.functions.text import composite_key, row_kind

    columns = "sample_id string, data_source string, strain string, chemical string, medium string, temperature string, pert_time bigint, pert_time_unit string, split string"
    rows = [
        ("tr_ctrl", "D1", "S1", "Water", "M1", "30", 15, "min", "train"),
        ("tr_a", "D1", "S1", "DrugA", "M1", "30", 15, "min", "train"),
        ("tr_b", "D1", "S2", "DrugB", "M1", "30", 30, "min", "train"),
        ("val_chem", "D1", "S1", "DrugC", "M1", "30", 15, "min", "val_chem_only"),
        ("val_strain", "D1", "S3", "DrugA", "M1", "30", 15, "min", "val_strain_only"),
        ("val_both", "D1", "S3", "DrugC", "M1", "30", 15, "min", "val_both"),
        ("val_time", "D1", "S1", "DrugA", "M1", "30", 60, "min", "val_time"),
    ]
    samples = spark.createDataFrame(rows, columns).withColumn("kind", row_kind("chemical")).withColumn(
        "match_key", composite_key(["data_source", "strain", "medium", "temperature", "pert_time", "pert_time_unit"])
    )
    values = {
        "tr_ctrl": (8, None, None), "tr_a": (16, 4, None), "tr_b": (32, 8, None), "val_chem": (12, 6, 2),
        "val_strain": (14, 7, 2), "val_both": (11, 5, 2), "val_time": (15, 9, 2),
    }
    cells = [(s, f"P{i + 1}", float(v)) for s, vs in values.items() for i, v in enumerate(vs) if v is not None]
    return samples, spark.createDataFrame(cells, "sample_id string, protein string, value double")
