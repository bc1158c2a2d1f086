"""Queries of the engine over the test tables, each with an equivalent SQL text."""
