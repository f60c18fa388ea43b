"""Training-data operators: near-dedup, archives, mixing, extraction, tokens, search, filters, chat, quality, licences."""
