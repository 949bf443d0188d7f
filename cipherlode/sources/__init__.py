"""Readers: a source tree, lockfiles and manifests, TLS configuration files."""
