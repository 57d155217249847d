"""The registry of queries and the SQL that checks them."""
