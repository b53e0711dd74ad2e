"""Reading and writing of catalog tables, pages and exports."""
