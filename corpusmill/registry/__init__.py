"""Named queries over the driver tables, each with the SQL text that must give equal rows."""

from corpusmill.registry.base import ORACLES, QUERIES
from corpusmill.registry import (  # noqa: F401  (importing registers the queries)
    corpus,
    samples,
    scores,
    tokens,
    models,
    structure,
    continual,
    streams,
    training,
)

__all__ = ["ORACLES", "QUERIES"]
