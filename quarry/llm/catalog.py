"""Importing this module registers every query of the subpackage."""

from quarry.llm import queries  # noqa: F401
from quarry.llm.registry import ORACLE, QUERIES  # noqa: F401
