"""tremolite: gap-aware multi-channel time-series analytics on Apache Spark.

Operators are pure functions ``DataFrame -> DataFrame``; nothing is executed until
the caller writes or collects.  See README.md for the catalogue.
"""

__version__ = "0.1.0"
