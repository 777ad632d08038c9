"""platelens: catalogue / menu analytics on Spark DataFrames.

Every public operator takes and returns a ``pyspark.sql.DataFrame``; column
names are parameters. Sub-packages:

* ``functions``  column expressions (name cleaning, word split/join, labels)
* ``sources``    CSV / table sources and sinks, surrogate keys
* ``operators``  joins, reports, ranking, scaling, k-means, PCA
* ``plans``      item-shaped views over the driver tables and the query registry
* ``streaming``  incremental (file-stream) ingest of new CSV drops
"""

__version__ = "0.1.0"
