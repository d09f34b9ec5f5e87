"""plans of lakesieve."""
