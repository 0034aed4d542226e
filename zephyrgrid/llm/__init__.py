"""Operators of a training-data pipeline: ten dealt methods over documents, vectors and pages."""
