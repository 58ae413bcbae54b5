"""Operators on conversation and document text. Nothing else in the library imports this."""
