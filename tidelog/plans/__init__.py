"""Queries by area; importing the package registers them."""

from . import catalogue, changes, conversions, logs, streams, surface, wider  # noqa: F401
