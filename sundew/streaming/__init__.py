"""Streaming forms: events arrive with ``ts`` (timestamp), ``ts_ms`` and ``seq``."""
