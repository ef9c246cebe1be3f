"""Stateful streaming: the monitor, batches by count or time, live georeferencing, change feeds."""
