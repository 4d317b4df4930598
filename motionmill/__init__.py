"""Spark jobs over multi-channel recordings: frames, features, selection, scoring."""
