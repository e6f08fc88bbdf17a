"""ioloom: a PySpark library that diagnoses large collections of I/O counter logs."""
