"""Perturbation-response analytics as Spark DataFrame operators.

The data model is a sample table (one row per measured condition) and a long
cell table ``(sample_id, protein, value)``.  Every operator takes and returns
DataFrames and stays lazy; nothing is collected on the driver.
"""

__version__ = "0.1.0"
