"""Chronograft: durable-pattern analytics over temporal graphs, expressed as Spark plans."""
