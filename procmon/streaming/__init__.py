"""Scoring running cases: in batch (R1) and on a stream (R2)."""
