"""shelfcast.plans."""
