"""Operators for preparing text corpora, each usable on its own; `queries` registers one query each."""
