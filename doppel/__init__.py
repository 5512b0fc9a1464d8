"""Look-alike transfer detection on Spark."""
