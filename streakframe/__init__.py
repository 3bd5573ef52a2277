"""Diffraction-frame analytics on Spark: frames, pixels, streaks, panels and orientations as tables."""
