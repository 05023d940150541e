"""All registered queries and their SQL."""

from evispark.plans import audit_queries, document_queries, evidence_queries, function_queries, matching_queries, page_queries, report_queries, rollup_queries, rubric_queries, snapshot_queries, stage_queries, structure_queries, text_queries  # noqa: F401
from evispark.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
