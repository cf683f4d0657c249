"""Sources, sinks and stores."""
