"""Training-data operators: tokens, languages, near duplicates, archives, mixing, scoring, vectors.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; where numpy does the arithmetic it works on Arrow batches
inside Spark tasks, over rows that Spark has partitioned.
"""
