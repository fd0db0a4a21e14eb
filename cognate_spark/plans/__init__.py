"""Whole jobs, adapters of the driver's tables, and the registered queries."""
