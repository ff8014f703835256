"""simpairs package."""
