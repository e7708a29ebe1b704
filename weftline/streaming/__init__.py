"""Query logs that keep arriving: an extension, kept apart from the batch scan."""
