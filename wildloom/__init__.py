"""wildloom: LIKE patterns and text-table processing, declared as Spark plans."""

from wildloom.operators.wildcard import first_match, wildcard_join
from wildloom.plans.patterns import prepare_patterns, spark_like

__all__ = ["first_match", "prepare_patterns", "spark_like", "wildcard_join"]
