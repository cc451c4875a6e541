"""Quad streams into incremental materialisation."""
