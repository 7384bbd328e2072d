"""Operators of a training-data pipeline. Nothing outside this package and
``corpus_pipeline.py`` imports it; the driver contract adds its queries only
when it is present."""
