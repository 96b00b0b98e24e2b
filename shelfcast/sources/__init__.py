"""shelfcast.sources."""
