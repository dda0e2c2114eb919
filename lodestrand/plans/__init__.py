"""The graph query language: text, syntax tree, DataFrame plan."""
