"""Column-level helpers (Column -> Column), all built from pyspark.sql.functions."""
