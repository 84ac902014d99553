"""Almanac: event-study analytics as Spark DataFrame programs."""
