"""codecorpus: DataFrame operators for building and scoring source-code corpora.

Every public operator is a lazy ``DataFrame -> DataFrame`` function.  Cross-row
work (joins, ranking, sampling, aggregation) is plain Spark; the only custom
per-row code is the span scanner (``operators.spans``) run via ``mapInArrow``
and the pluggable tokenizer (``operators.training``).
"""

from codecorpus.session import get_spark

__all__ = ["get_spark"]
