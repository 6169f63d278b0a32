"""Readers, the versioned dataset store, exports and seeded workloads."""
