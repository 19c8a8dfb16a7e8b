"""All registered queries."""

from wayside.plans import q_context, q_evaluation, q_ingest, q_links, q_pages, q_quality, q_retrieval  # noqa: F401
from wayside.plans.registry import oracle_sql, runnable  # noqa: F401
