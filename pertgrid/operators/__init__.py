"""Operators over long relations of counts, observations and effects."""
