"""Importing this module registers every query."""

from chronodiff.plans import changes, history, planning, rules, streams, texts  # noqa: F401
