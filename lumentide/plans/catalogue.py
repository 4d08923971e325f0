"""All registered queries of the media-signal engine and their SQL twins."""

from lumentide.plans import face_queries, image_queries, job_queries, signal_queries, time_queries  # noqa: F401
from lumentide.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
