"""Sources and sinks: JSON-lines readers, table writers, the test-data adapter."""

from . import fixtures, jsonl, tables  # noqa: F401
