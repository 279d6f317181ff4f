"""Reading raw records and reading, writing and replacing the tables."""
