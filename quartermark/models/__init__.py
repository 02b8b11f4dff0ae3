"""Model seams: pluggable providers with deterministic offline defaults."""
