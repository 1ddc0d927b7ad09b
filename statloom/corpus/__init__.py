"""R history files as three tables: files, commands and function calls."""
