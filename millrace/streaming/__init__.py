"""Sessions, callbacks and replay."""
