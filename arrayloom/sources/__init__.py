"""Archives: writing, reading, discovery and validation."""
