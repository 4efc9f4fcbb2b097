"""See the repository README."""
