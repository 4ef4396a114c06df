"""Importing this package fills ``plans.registry.QUERIES`` / ``ORACLE``."""

from . import evaluation, features, labels, models, prep, windows  # noqa: F401
