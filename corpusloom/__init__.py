"""Corpus and token analytics on Spark: byte-pair-encoding training and coding,
token-stream sinks, streaming encoding and vector operators on DataFrames."""

from .operators.bpe import BpeModel, train_bpe, train_bpe_distributed

__all__ = ["BpeModel", "train_bpe", "train_bpe_distributed"]
