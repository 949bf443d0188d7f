"""DataFrame operators: lexical facts, detectors, dependencies, TLS entries."""
