"""Spark-first signal, spectrogram and interval-event analytics."""
