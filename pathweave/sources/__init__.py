"""Reading, lookups and sinks."""
