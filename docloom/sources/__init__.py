"""Sources: files and folders, PDF pages by plug-in readers, paginated markdown."""
