"""functions of lakesieve."""
