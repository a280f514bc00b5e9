"""Large-corpus text operators for training-data pipelines.

Self-contained: nothing else in the library imports this subpackage.
"""
