"""Factor expressions, panels, scoring and candidate management as Spark plans."""

__version__ = "0.1.0"
