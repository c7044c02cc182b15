"""All queries of this subpackage, the pipeline included; importing this module fills the registry."""

import corpus_pipeline
from foliospark.llm import queries  # noqa: F401
from foliospark.llm.registry import ORACLES, QUERIES, query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

__all__ = ["ORACLES", "QUERIES"]
