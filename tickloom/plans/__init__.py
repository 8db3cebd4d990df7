"""The questions asked of the tables, and the catalogue of checked queries."""
