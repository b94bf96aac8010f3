"""Operators on claim, evidence, paper and vocabulary tables."""
