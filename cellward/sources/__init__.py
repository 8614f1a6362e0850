"""Tables in and out: vocabularies, catalogs, query logs, audit files."""
