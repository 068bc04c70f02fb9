"""Small applications put together from the library."""
