"""Where tables come from and live."""
