"""Numpy kernels behind the Arrow operators; nothing here imports Spark."""
