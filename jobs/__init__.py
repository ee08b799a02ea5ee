"""Jobs with a command line and a config file each."""
