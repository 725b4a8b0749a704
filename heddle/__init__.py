"""heddle: a small analytics engine written on the PySpark DataFrame and SQL APIs."""
