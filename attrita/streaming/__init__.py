"""Structured Streaming jobs: customer scoring (T1) and activity monitoring."""
