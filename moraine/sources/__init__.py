"""Where mutations, runs and the manifest are kept."""
