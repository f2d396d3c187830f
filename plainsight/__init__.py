"""Sensitive-information exposure analytics as Spark DataFrame operators."""

from plainsight.session import build_session, cut_lineage, read_table, scratch_path

__all__ = ["build_session", "cut_lineage", "read_table", "scratch_path"]
