"""Storage and server telemetry on Spark.

Everything here is a function from DataFrame to DataFrame.  Text snapshots
become tagged points (``operators.extract``), counters become rates, rates are
rolled up over time and tags, and the panels in ``plans`` answer the usual
operational questions.
"""

__version__ = "0.1.0"
