"""Registered queries and the arrays they run on."""
