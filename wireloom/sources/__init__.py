"""Table, capture-file and catalog sources and sinks."""
