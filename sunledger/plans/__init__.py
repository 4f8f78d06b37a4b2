"""plans of sunledger."""
