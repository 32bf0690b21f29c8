"""Queries, their SQL counterparts and the generated source corpus they run on."""
