"""All queries of the core with their SQL."""

from __future__ import annotations

from tidemark.plans import attention, ingest, lookups, problems

QUERIES = {**problems.QUERIES, **attention.QUERIES, **ingest.QUERIES, **lookups.QUERIES}
SQL: dict[str, str] = {**problems.SQL, **attention.SQL, **ingest.SQL, **lookups.SQL}
FLAGSHIP = "report_repositories"
