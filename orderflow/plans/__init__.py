"""Whole jobs, and the adapters from the driver's tables to order and log records."""
