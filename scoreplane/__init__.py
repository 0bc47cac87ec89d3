"""scoreplane: evaluation analytics for structured model predictions on Spark.

DataFrame in, DataFrame out.  Sub-packages:

* ``functions``  column expressions (text, JSON, media, time, vectors, label sets)
* ``operators``  relational building blocks (pairs, classification metrics,
  multi-label metrics, similarity, experiment grid, batch generation, reports)
* ``sources``    scans and sinks (parquet tables, CSV/JSON/text/binary files)
* ``plans``      end-to-end plans over the shared test tables, the query registry
  and the DuckDB oracle text
* ``streaming``  incremental evaluation over files that keep arriving
"""

__version__ = "0.1.0"
