"""Registered queries, by area; importing the package fills the registry."""

from . import audit, discover, hierarchy, merge, placement, reconcile, scalars, scopes, streams  # noqa: F401
