"""sluice: move, clean, compare and report on data with plain Spark DataFrames.

Every operator is a function from DataFrames to a DataFrame; see the subpackages
``sources``, ``functions``, ``operators``, ``sinks``, ``streaming`` and ``plans``.
"""
