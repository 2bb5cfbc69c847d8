"""Hooks into a plan: functions over rows, repairs of messages, and registries of what a plan may name."""
