"""Operators for preparing training data at scale; see each module for its method."""
