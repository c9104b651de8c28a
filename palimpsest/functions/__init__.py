"""Column functions: all native expressions, no Python at run time."""
