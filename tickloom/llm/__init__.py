"""Operators for text corpora: filtering, deduplication, decontamination, mixing and counting."""
