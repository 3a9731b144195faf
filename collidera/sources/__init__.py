"""Reading and writing collision tables and code books."""
