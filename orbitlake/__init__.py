"""Spark-native analytics for particle trajectories, thermodynamic series and text corpora."""
