"""PySpark jobs for booking orders and user-behaviour logs."""
