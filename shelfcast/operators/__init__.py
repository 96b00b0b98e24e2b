"""shelfcast.operators."""
