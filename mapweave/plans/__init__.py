"""The batch build, the online queries, and the registry of both with their SQL."""
