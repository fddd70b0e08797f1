"""Frequencies, periods and calendar arithmetic, on the driver and as Spark columns."""
