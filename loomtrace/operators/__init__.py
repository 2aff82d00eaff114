"""Operators over sessions, steps and records."""
