"""Files and folders as records."""
