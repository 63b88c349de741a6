"""Sources, sinks and table changes."""
