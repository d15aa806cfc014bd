"""Operators on edge tables, embeddings and blocks, and per-key results under skew."""
