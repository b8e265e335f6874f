"""The library's queries by name."""

from shalecrest.plans import chunks, corpus, quality, retrieval, store, telemetry  # noqa: F401
from shalecrest.plans.registry import QUERIES, SQL  # noqa: F401
