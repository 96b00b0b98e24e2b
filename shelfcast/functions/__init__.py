"""shelfcast.functions."""
