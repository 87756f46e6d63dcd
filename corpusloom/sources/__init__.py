"""Readers for the tables a corpus is made of."""

from corpusloom.sources.tables import TABLES, read_parts, read_prompts, table  # noqa: F401
