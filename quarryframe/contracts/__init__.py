"""Output contracts by version: schemas, vocabularies, the validator made from a schema, and the strict parser."""
