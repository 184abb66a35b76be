"""DataFrame operators on leaves, points, transfers and query points."""
