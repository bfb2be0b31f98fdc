"""Training-data operators: deduplication, filtering, mixing, packing, search, archives and extraction.

Nothing outside this subpackage imports it.  Every operator is a function over DataFrames with its own parameters; the
``opN_*`` queries in :mod:`landspark.llm.queries` are thin digests of the operators' outputs.
"""
