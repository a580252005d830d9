"""DataFrame operators, one module per job."""
