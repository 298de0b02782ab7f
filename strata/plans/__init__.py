"""End-to-end plans: create, extract, probe."""
