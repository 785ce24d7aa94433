"""Named query plans over the driver tables (fixtures, queries, oracles)."""
