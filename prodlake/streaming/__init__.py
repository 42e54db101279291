"""Event-time aggregates over streams."""
