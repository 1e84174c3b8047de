"""Narration-text preparation and corpus analytics as PySpark DataFrame transforms."""
