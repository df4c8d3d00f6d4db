"""All registered queries of the library, without the training-data operators."""

from .plans import aramex, changing, flows, importing, labelling, listing, reporting, scalars, serving  # noqa: F401
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
