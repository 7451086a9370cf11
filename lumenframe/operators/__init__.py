"""DataFrame operators. Each module takes and returns DataFrames; nothing here starts a session."""
