"""lumenloom: a Spark-native engine for agent-trajectory and document-QA data."""

__version__ = "0.1.0"
