"""Registered queries: each applies an operator to the test tables and names the SQL it is held against."""
