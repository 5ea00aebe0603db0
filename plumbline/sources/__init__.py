"""Scans: table folders, source files, archives, test-runner logs."""
