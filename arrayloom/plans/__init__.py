"""Pipelines, transform steps and the registered queries."""
