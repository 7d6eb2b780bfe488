"""Structured Streaming forms: an extension, since the batch engine this rebuilds has no streams."""
