"""DataFrame to DataFrame operators. Column names are arguments throughout."""
