"""Reading raw files, checking them, and loading the domain tables."""
