"""tillstar: a PySpark-native retail analytics engine.

Layers
------
* ``sources``   – readers (driver parquet tables, CSV/flat files, JDBC, file
  listings, catalog helpers) and writers (sinks).
* ``functions`` – Column-level helpers (exact money rounding, date attributes,
  text normalisation, coercion of dirty values).
* ``operators`` – DataFrame -> DataFrame building blocks (conforming, cleaning,
  dimensions, fact, filters, metrics, quality checks, sentiment, matching,
  extraction, shaping).
* ``plans``     – end-to-end jobs: the star-schema build from the driver tables,
  the query registry and the equivalent DuckDB SQL used as an oracle.
"""

__all__ = ["__version__"]
__version__ = "0.1.0"
