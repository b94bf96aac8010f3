"""Queries over the tables of a directory, with SQL that gives the same rows."""
