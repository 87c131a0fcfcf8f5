"""Registered queries: every operator on the star-schema and event tables, beside equivalent SQL."""

from deedlink.workloads.registry import WORKLOADS, load_all

__all__ = ["WORKLOADS", "load_all"]
