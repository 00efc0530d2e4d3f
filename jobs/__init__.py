"""Jobs to run on a cluster: each a function over a session and paths, with a command line and a config file beside it."""
