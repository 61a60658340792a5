"""Wiring of the library to the generated test tables."""

from .registry import ORACLES, QUERIES
from . import q_marts, q_core, q_reports, q_models

__all__ = ["ORACLES", "QUERIES"]
