"""DataFrame operators over the catalog."""
