"""The text operators over streams."""
