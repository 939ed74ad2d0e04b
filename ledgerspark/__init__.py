"""Spending analytics for all users at once, on Spark DataFrames.

Layout:
  sources/    adapters from the driver tables, CSV/JSON files, table maintenance
  functions/  column-level scalar helpers (dates, money, text, bands)
  operators/  DataFrame -> DataFrame operators (filters, summaries, features,
              rules, explanations, models, metrics)
  plans/      assembled jobs (training, prediction report, explanation report)
              and the query catalogue used by ``__spark_entry__``
  streaming/  Structured Streaming form of batch ingestion
"""

__version__ = "0.1.0"
