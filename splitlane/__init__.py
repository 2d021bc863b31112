"""Controlled-experiment analytics over large event logs, as Spark DataFrame jobs."""
