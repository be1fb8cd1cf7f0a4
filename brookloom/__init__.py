"""Document, knowledge-base and event-log analytics as plain DataFrame operators."""

__version__ = "0.1.0"
