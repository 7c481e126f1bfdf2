"""Part of the cadenza engine; see README.md."""
