"""Operators for preparing large training corpora; self-contained, nothing else in the library imports it."""
