"""Reading, writing and describing the accommodation tables."""
