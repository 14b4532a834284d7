"""How much of a dimension goes to the tasks at once."""

BROADCAST_BYTES = 64 * 1024 * 1024
