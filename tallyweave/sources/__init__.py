"""Tables that the queries read."""
