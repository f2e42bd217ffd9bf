"""Readers and writers: JSON lines, feeds, captured probes, SIEM rows, deliveries."""
