"""Relational and analysis operators; each module documents its own null, tie and empty-input results."""
