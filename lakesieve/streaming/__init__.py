"""streaming of lakesieve."""
