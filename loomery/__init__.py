"""Loomery: event-time, state-machine and corpus analytics expressed as Spark plans."""
