"""Named analyses (Spark plans) and their DuckDB oracles."""

from .context import Tables  # noqa: F401
from .registry import ANALYSES, ORACLES, load_all  # noqa: F401
