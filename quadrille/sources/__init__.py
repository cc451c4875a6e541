"""Triple sources: mapped tables, quad tables and RDF files."""
