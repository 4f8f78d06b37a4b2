"""operators of sunledger."""
