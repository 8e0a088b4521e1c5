"""Cost model and choice of a join strategy."""
