"""Where datasets come from and where results go."""
