"""Operators for text corpora that train or test language models."""
