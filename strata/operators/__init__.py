"""Operators on manifests, blocks, chunks and bytes."""
