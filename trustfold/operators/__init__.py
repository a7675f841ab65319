"""DataFrame operators: dealing, pairing, training, distance, scoring, averaging, exchange."""
