"""Readers and writers for logs, weather and settings."""
