"""Plan-level helpers (skew, staging, numbering) and the batch jobs."""
