"""DataFrame operators: joins, sampling, metrics, outfits, masks."""
