"""Circulation analytics for a lending library, as Spark DataFrame jobs."""

from circdesk.model.tables import Tables

__all__ = ["Tables"]
