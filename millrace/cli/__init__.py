"""Command line: inspect, validate, export and run a blueprint."""
