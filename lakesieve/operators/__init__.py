"""operators of lakesieve."""
