"""Writers for facts, scores and payload documents."""
