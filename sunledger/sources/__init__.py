"""sources of sunledger."""
