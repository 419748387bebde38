"""Pipelines and models composed of the operators."""
