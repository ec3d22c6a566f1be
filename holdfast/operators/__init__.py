"""DataFrame operators of a repeated hold-out study."""
