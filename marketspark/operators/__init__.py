"""DataFrame-in, DataFrame-out operators: cleaning, star schema, quality, measures, text check."""
