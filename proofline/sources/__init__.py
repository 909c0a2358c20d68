"""Scans of recorded provider answers, fixtures and reports, and the sinks of results."""
