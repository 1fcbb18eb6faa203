"""Findings and logs written for other tools."""
