"""Frames to trees of typed fields."""
