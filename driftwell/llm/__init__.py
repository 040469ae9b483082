"""Operators for preparing language-model training data at scale.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; Python code runs only inside Arrow batches on the executors.
"""
