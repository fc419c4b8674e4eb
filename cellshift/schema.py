"""Column names, required input columns and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

# The metadata contract of the input files (file column -> our name).
METADATA_COLUMNS = {
    "sample_ID": "sample_id",
    "data_source": "data_source",
    "Strains": "strain",
    "Medium": "medium",
    "Temperature": "temperature",
    "pert_time": "pert_time",
    "pert_time_unit": "pert_time_unit",
    "pert_id": "pert_id",
    "perturbation_no_concentration": "chemical",
    "instrument": "instrument",
    "Yeast_cell_plate": "plate",
    "protein_well": "well",
    "split_final": "split",
    "strain_role": "strain_role",
    "chemical_role": "chemical_role",
}

# Fields that must agree between a treatment and its controls.
MATCH_FIELDS = (
    "data_source",
    "instrument",
    "plate",
    "strain",
    "medium",
    "temperature",
    "pert_time",
    "pert_time_unit",
)

# Names that mark control and quality-control rows.
CONTROL_NAMES = ("water", "dmso")
QUALITY_CONTROL_NAMES = ("quality control",)

# Validation and test split labels.
VALIDATION_SPLITS = ("val_chem_only", "val_strain_only", "val_both", "val_time")
TEST_SPLITS = ("test_chem_only", "test_strain_only", "test_both", "test_time")

# Separator of composite keys; it cannot occur in a cleaned name.
KEY_SEP = "\x1f"

# The two keys of the long cell table.
CELL_KEYS = ("sample_id", "protein")


def metadata_schema() -> T.StructType:
    """Explicit reader schema: every key stays text, only the time is a number."""
    return T.StructType(
        [
            T.StructField(name, T.DoubleType() if name == "pert_time" else T.StringType())
            for name in METADATA_COLUMNS
        ]
    )
