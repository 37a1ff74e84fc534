"""The live feed as a stream."""
