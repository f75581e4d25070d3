"""Operators for training corpora: filtering, deduplication, decontamination, tokenization and archives."""
