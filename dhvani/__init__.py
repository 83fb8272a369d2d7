"""dhvani — speech/text corpus preparation and scoring as Spark jobs.

Every operator takes and returns DataFrames (or Columns) and is built from
built-in Spark SQL expressions, joins, aggregations and windows.
"""

__version__ = "0.1.0"
