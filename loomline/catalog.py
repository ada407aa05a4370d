"""Every registered query of the core, with its SQL."""

from loomline.operators import briefing, clusters, entities, evaluation, exports, feed, ingest, lists, metrics, pairs, reports, requests, review, scalars, tasks  # noqa: F401
from loomline.registry import QUERIES, SQL  # noqa: F401
from loomline.streaming import views  # noqa: F401
