"""Bar series: files, fixtures and synthetic data."""
