"""quarry: table-in, table-out analytics operators on PySpark.

Every operator is a function that takes DataFrames and returns a DataFrame;
the work runs on Spark executors.  Sub-packages:

* ``sources``   - scans, writes, snapshot changes (A rows of SURVEY §2)
* ``operators`` - relational, quality, imbalance, statistics, business, models
* ``functions`` - shared Column expressions and skew-safe helpers
* ``plans``     - the query registry used by ``__spark_entry__`` and ``bench.py``
* ``streaming`` - micro-batch form of the atomic batch append
"""

__version__ = "0.1.0"
