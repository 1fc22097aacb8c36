"""Where graphs, configurations and tables come from and go to."""
