"""The same jobs over unbounded feeds."""
