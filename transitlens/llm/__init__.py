"""Operators for training-data pipelines. Nothing else in the library imports this package;
its queries and oracles are in ``transitlens.llm.queries``."""
