"""foldwise: large-table regression preparation, evaluation and scoring on Spark.

Cross-validation is data (a ``fold`` column), statistics are one-pass
aggregates keyed by fold, and only small summaries (d x d matrices, level
maps, report rows) ever reach the driver.
"""

__version__ = "0.1.0"
