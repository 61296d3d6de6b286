"""sparkprep: tabular prepare / profile / model / evaluate / explain operators on Spark.

Every operator is a function ``DataFrame -> DataFrame`` (usable through
``df.transform``) built from Spark SQL expressions, windows, shuffles and
Spark ML stages.  Sub-packages:

* ``sources``   – CSV / Parquet scans and sinks
* ``functions`` – reusable column expressions (null-safe predicates, hashing)
* ``operators`` – row / column / profile / sampling / feature / evaluation /
  explanation operators
* ``plans``     – multi-step compositions (ingest, preprocess, model training)
* ``streaming`` – notes on stream use (the reference has no streaming)
* ``catalog``   – the registered check queries and their SQL oracles
"""

__version__ = "0.1.0"
