"""Building blocks that several operators share: written tables and connected components."""
