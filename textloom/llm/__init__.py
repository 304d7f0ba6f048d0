"""Training-data operators: filtering, dedup, decontamination, mixing, sharding and friends."""
