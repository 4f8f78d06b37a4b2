"""functions of sunledger."""
