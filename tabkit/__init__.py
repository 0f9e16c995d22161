"""tabkit: take a table from raw data to a compared, saved and applied model, on Spark."""

__version__ = "0.1.0"
