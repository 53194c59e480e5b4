"""Registered queries: every family module adds to the registry on import."""
