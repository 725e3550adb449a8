"""Registered queries, by group."""

from outfall.queries.registry import ORACLES, QUERIES  # noqa: F401
from outfall.queries import files, findings, gate, history, inventory, reading, review, streams, text  # noqa: F401
