"""Query plans over the star schema: search, comparison, catalogue, history, autocomplete."""
