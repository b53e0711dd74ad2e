"""Column functions: no Python runs per row, except the page parser in ``html``."""
