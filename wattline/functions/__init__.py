"""Column builders: rules, calendar, geometry, hashing and text."""
