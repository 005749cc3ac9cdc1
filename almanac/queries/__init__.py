"""Registered queries: each operator over the supplied tables, with its SQL check."""

from . import cleaning, descriptive, features, maintenance, models, scanning, scoring, streams, timeline, weather  # noqa: F401
from .base import REGISTRY

__all__ = ["REGISTRY"]
