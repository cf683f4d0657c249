"""Operators: search, graphs, sketches, temporal graphs, events, knowledge, memory, reasoning, text, decisions."""
