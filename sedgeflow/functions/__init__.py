"""Column functions: business time, identities, the event contract."""
