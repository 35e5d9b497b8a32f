"""Joins, aggregations and detectors over tables of images, lines and regions."""
