"""Developer-productivity analytics over code-review and CI/CD data, as PySpark jobs."""

__version__ = "0.1.0"
