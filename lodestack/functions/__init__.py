"""Column functions over text and configuration values."""
