"""Scalar functions: key codec, property encoders, tile arithmetic, GeoJSON."""
