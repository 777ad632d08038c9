"""Item-shaped views over the driver tables, end-to-end jobs and the query
registry used by ``__spark_entry__``."""
