"""Incremental work. There is no unbounded source; partitions are added batch by batch."""
