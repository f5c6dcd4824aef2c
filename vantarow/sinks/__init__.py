"""Writers of series, indexes, models, reports, logs and state."""
