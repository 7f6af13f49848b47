"""Row-level features on streaming frames."""
