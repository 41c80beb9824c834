"""Queries of the reference-level operators, by subject; importing ``registered``
collects them all."""
