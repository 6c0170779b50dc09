"""ledgerlens: sales analytics and forecasting as Spark DataFrame operators.

Every operator is `f(df, keys=(), ...) -> DataFrame`; `keys` name the segment columns, so
the whole table and any set of segments are computed in one job.
"""

__version__ = "0.1.0"
