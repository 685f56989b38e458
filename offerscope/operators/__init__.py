"""Reusable relational operators (DataFrame → DataFrame)."""

from . import impute, lifecycle, prepare, profiling, spend  # noqa: F401
