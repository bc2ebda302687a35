"""Telemetry cleaning and summarising as composable DataFrame operators."""
