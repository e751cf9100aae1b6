"""Where rows come from: registry, decoders, record types, the block cache."""
