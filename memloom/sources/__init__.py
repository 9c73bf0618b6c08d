"""Scans of archives, workspaces and tables, and the sinks that write them."""
