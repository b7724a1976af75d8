"""The same measures over streams."""
