"""Forecasts and classifiers trained from Spark frames."""
