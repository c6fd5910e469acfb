"""Scoring of streams against a finished corpus."""
