"""Named queries that compose the operators, with their SQL oracles."""
