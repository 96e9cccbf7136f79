"""Event-time telemetry analytics and data-processing operators on Spark."""

__version__ = "0.1.0"
