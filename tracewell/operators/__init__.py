"""Relational and graph operators over record corpora."""
