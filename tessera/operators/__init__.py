"""Relational and sequence operators over reads, calls, segments and intervals."""
