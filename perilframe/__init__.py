"""A PySpark engine for property-level natural-hazard data."""
