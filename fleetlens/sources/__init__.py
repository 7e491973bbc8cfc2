"""Readers and writers for snapshots, command output, points and reports."""
