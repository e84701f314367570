"""Threshold pairs of the registered sweeps."""

ACCEPTS, REJECTS = (0.71571, 0.71271, 0.70971, 0.70671), (0.70531, 0.70331, 0.50251)
