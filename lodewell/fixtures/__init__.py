"""A writer of small pool images, for tests."""
