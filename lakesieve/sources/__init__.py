"""sources of lakesieve."""
