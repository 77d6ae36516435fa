"""DataFrame-to-DataFrame operators. Nothing here runs an action."""
