"""Column functions: edge names, seeded hashing and vector arithmetic."""
