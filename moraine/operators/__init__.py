"""DataFrame operators of the engine: pure functions over mutations, run entries and the manifest."""
