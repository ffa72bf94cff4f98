"""Jobs to be run from the command line; each is a function of a session that the command line calls."""
