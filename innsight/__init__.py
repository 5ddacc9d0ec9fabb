"""Price and demand analytics over accommodation tables, built on Spark."""
