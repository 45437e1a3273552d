"""Relational operators over graph and profile frames."""
