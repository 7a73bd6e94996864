"""Reading and shaping event logs and loads."""
