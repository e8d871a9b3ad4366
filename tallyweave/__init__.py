"""Seeded weighted sampling and exact metric serialisation on Spark."""

from .operators import Sampler, parse_metrics, render_metrics

__all__ = ["Sampler", "parse_metrics", "render_metrics"]
