"""Sources and sinks: driver tables, manifests, transcript files, audio inventories."""
