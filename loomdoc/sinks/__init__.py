"""Trees and tables as files."""
