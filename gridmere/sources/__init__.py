"""Readers and writers. Text stays text until a column's role types it."""
