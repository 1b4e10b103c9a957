"""A PySpark engine for alignment confidence: parsing, features, models, calibration."""
