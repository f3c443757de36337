"""Queries over the test tables, one module for each group of operators."""

from . import registry  # noqa: F401
from . import annotation, details, feed, further, handlers, integrate, layouts, linear, masks, maths, mixing, packing, selection, streams, text, trajectory  # noqa: F401  isort: skip
