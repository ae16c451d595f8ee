"""Schema models as tables: everything is derived from element rows of XSD or model documents by joins."""
