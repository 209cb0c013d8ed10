"""Sources: files of lines, stores in SQLite, and the transcript adapters on top of them."""
