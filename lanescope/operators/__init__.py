"""Operators: functions from DataFrame to DataFrame, lazy throughout."""
