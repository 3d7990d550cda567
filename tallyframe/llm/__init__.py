"""Text-corpus operators for building training data.

Every operator takes and returns DataFrames.  Nothing else in the package imports this one.
"""
