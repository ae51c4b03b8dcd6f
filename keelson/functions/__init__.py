"""Part of keelson."""
