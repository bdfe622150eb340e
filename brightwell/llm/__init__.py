"""Corpus preparation for language models: ten operators, their queries and SQL.

Nothing outside this folder, `tests/llm` and `corpus_pipeline.py` imports it. Task functions travel
to the executors by value, so these need no copy of the package.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
