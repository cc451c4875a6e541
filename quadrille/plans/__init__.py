"""Query planning before Catalyst."""
