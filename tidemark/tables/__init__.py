"""Tables: versioned manifests, reads at an LSN, flushes and maintenance."""
