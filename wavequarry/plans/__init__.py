"""The registered queries: operators applied to the driver's tables."""

from . import audio, delivery, evidence, loudness, relations, signal, streams
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "audio", "delivery", "evidence", "loudness", "relations", "signal", "streams"]
