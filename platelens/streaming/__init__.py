"""Incremental ingest: CSV drops arriving in a folder, loaded batch by batch."""

from .ingest import start_menu_ingest

__all__ = ["start_menu_ingest"]
