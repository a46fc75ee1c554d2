"""The query catalogue: fixture views over the test tables, registered queries and their SQL."""
