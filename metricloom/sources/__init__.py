"""Reading inputs and handing results over."""
