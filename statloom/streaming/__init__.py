"""Row-wise commands on streams."""
