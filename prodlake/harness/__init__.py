"""Binds the operators to the supplied test tables: queries and independent SQL."""
