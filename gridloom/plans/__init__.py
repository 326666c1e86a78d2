"""Plan-time work: header schemas and their projections."""
