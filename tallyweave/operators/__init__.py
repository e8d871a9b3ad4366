"""Sampling and metric operators on DataFrames."""

from .metrics import parse_metrics, parse_rows, render_columns, render_metrics, render_rows
from .sampling import Sampler, sample_with_replacement, sample_without_replacement

__all__ = ["Sampler", "parse_metrics", "parse_rows", "render_columns", "render_metrics", "render_rows", "sample_with_replacement", "sample_without_replacement"]
