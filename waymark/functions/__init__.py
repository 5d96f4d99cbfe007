"""Part of the road-network engine."""
