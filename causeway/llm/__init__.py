"""Training-data operators: filtering, near duplicates, decontamination, packing, archives."""
