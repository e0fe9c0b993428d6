"""Importing this registers every query."""

from ledgerlake.plans import lake, ops, protocol, recovery, state, streams, views  # noqa: F401
from ledgerlake.plans.registry import ORACLES, QUERIES  # noqa: F401
