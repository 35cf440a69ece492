"""The same operators over streaming tables."""
