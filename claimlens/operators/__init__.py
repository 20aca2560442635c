"""DataFrame operators: encoding, top-k joins, retrieval, metrics, ledger."""
