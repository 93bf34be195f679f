"""DataFrame operators over observations and daily tables."""
