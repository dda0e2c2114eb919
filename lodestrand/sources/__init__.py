"""Where files come from, and how they become chunks."""
