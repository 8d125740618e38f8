"""Operators: ``DataFrame -> DataFrame``, lazy, no Python per row except the chunk packer and the vector tiles."""
