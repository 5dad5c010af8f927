"""Escalation-index analytics as composable Spark DataFrame operators."""
