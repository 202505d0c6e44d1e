"""PySpark library of batch and streaming jobs over prediction-market tables."""
