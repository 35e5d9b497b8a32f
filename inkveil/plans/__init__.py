"""Whole jobs: text check, detection, masking."""
