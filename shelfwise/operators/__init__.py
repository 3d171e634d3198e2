"""Relational operators: golden records, linking, routing, catalogue state."""
