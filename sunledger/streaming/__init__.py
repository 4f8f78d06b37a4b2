"""streaming of sunledger."""
