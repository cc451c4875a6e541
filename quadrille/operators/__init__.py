"""Operators above single queries: rules, shapes, entailment, templates, updates."""
