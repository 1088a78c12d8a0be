"""All queries of the engine: importing the plans registers them."""

from . import behavior, coverage, documents, evaluation, identity, playback, queries, review, reviewing, statistics, stored, streams, timeline, trajectories  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
