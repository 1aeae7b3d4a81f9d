"""Stages, models, rules and reports."""
