"""Spectra built from a stream of raw samples."""
