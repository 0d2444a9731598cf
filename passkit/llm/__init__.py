"""Training-data pipeline operators (dedup, filtering, encoding, archives)."""
