"""Preparation and exploratory statistics of coded collision tables on Spark."""
