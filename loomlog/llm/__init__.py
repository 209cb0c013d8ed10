"""Training-data operators on records, conversations and texts. Nothing outside this folder imports it."""
