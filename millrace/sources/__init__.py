"""Readers, writers, manifests and stores."""
