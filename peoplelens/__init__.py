"""Audit, cleaning, feature engineering and exploration of people data on Spark."""
