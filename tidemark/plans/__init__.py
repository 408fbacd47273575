"""Domain computations: catch, survey, compositions, scenarios, smoothing, models, space."""
