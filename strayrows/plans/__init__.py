"""Views over the tables and the queries built on them."""
