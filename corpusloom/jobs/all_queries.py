"""All queries of the library proper."""

from corpusloom.jobs import content_queries, project_queries  # noqa: F401  they register their queries
from corpusloom.jobs.queries import ORACLES, QUERIES  # noqa: F401
