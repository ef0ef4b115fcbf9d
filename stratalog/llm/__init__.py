"""Operators for preparing text corpora: one module per operator, queries in ``catalog``.

Nothing outside this folder imports it.  Every operator takes and returns
DataFrames; what it keeps between jobs goes to the folder named by
``spark.checkpoint.dir`` (see ``common.shared_dir``).
"""
