"""The registered queries and their equivalents in SQL."""
